"""Gaussian-process fits against direct solutions; direction of planted causes."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import process


def standard(v):
    return (v - v.mean()) / v.std(ddof=1)


def test_mean_and_likelihood_equal_a_direct_solution():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 3, 25))
    y = np.sin(2 * x) + 0.3 * y
    for kind in ("DotProduct", "RBF"):
        mean, best = process.fitted(x, y, kind)
        for b in range(3):
            tried = []
            for k in process.kernels(x, kind):
                for noise in process.NOISES:
                    c = k[b] + noise * np.eye(25)
                    value = -0.5 * y[b] @ np.linalg.inv(c) @ y[b] - 0.5 * np.linalg.slogdet(c)[1] - 12.5 * np.log(2 * np.pi)
                    tried.append((value, k[b] @ np.linalg.inv(c) @ y[b]))
            value, want = max(tried, key=lambda t: t[0])
            assert best[b] == pytest.approx(value) and np.allclose(mean[b], want, atol=1e-8)


def test_product_kernel_is_a_ridge_line():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 40))
    y = 0.8 * x + 0.2 * rng.normal(size=(1, 40))
    mean, _ = process.fitted(x, y, "DotProduct")
    assert np.linalg.matrix_rank(np.column_stack([x[0], np.ones(40), mean[0]]), tol=1e-8) == 2


def test_direction_of_planted_causes():
    rng = np.random.default_rng(2)
    right = 0
    for k in range(20):
        x = rng.uniform(-2, 2, 120)
        y = (x**3 if k % 2 else np.exp(x)) + rng.uniform(-1, 1, 120)
        x, y = standard(x)[None], standard(y)[None]
        right += process.noise_dependence(x, y)["v"][0] < process.noise_dependence(y, x)["v"][0]
    assert right >= 18


def test_rows_and_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=50)
    series = {"x": x, "line": 2 * x + 0.5 * rng.normal(size=50), "wave": np.sin(3 * x), "flat": np.ones(50)}
    rows = [("s", k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {}
    for fn in (process.spi_gpfit, process.spi_anm):
        got |= {(r.spi, r.node_from, r.node_to): r.value for r in fn(panel).collect()}
    assert got["gpfit_RBF", "x", "wave"] < 0.2 < 0.5 < got["gpfit_DotProduct", "x", "wave"]
    assert got["gpfit_DotProduct", "x", "line"] < 0.2 and got["gpfit_RBF", "x", "flat"] is None and got["anm", "flat", "x"] is None
    assert got["anm", "x", "wave"] == pytest.approx(process.noise_dependence(standard(x)[None], standard(series["wave"])[None])["v"][0])
