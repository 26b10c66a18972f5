"""Penalised fits by moments against the converged iteration on the points."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import misc


def test_evidence_and_gradient_fits_equal_their_converged_definitions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60)
    series = {"x": x, "near": x + 0.1 * rng.normal(size=60), "far": rng.normal(size=60), "same": x, "flat": np.ones(60)}
    rows = [("s", k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)]
    got = {(r.spi, r.node_from, r.node_to): r.value for r in misc.spi_lmfit(zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))).collect()}
    z = {k: (s - s.mean()) / s.std(ddof=1) for k, s in series.items() if k != "flat"}
    for a in z:
        for b in z:
            if a == b:
                continue
            u, v = z[a], z[b]
            noise, weight = 60 / (v @ v + 1e-12), 1.0
            for _ in range(5000):
                slope = (u @ v) / (u @ u + weight / noise)
                used = noise * (u @ u) / (weight + noise * (u @ u))
                noise, weight = (60 - used + 2e-6) / (((v - slope * u) ** 2).sum() + 2e-6), (used + 2e-6) / (slope**2 + 2e-6)
            slope = (u @ v) / (u @ u + weight / noise)
            assert got["lmfit_BayesianRidge", a, b] == pytest.approx(((v - slope * u) ** 2).mean(), abs=1e-9)
            w = 0.0  # gradient descent on the penalised squared loss
            for _ in range(2000):
                w -= 0.5 * (w * (u @ u) / 60 - (u @ v) / 60 + misc.DECAY * w)
            assert got["lmfit_SGDRegressor", a, b] == pytest.approx(((v - w * u) ** 2).mean(), abs=1e-9)
    assert not any("flat" in k for k in got)
