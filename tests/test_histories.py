"""Transfer entropy with chosen histories against the estimator with the same histories fixed."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import infotheory as info


def test_history_of_a_lagged_process_is_found():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 200))
    for t in range(2, 200):
        x[:, t] += 1.2 * x[:, t - 1] - 0.8 * x[:, t - 2]
    got = info.best_history((x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))
    assert (got["k"] * got["tau"] >= 2).all() and (got["k_dce"] >= 1).all()
    white = info.best_history(rng.normal(size=(3, 14)))
    assert (white["k"] <= 2).all()  # longer histories leave too few points


def test_chosen_histories_equal_fixed_ones():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 5, 60))
    y[:, 1:] += 0.8 * x[:, :-1]
    for k in (1, 2):
        e = np.tile([1, 1, k, 1, 1, 1, k, 1], (5, 1)).astype(float)
        window = np.maximum(info.nb.decorrelation_time(x), info.nb.decorrelation_time(y))
        got = info.transfer_histories(x, y, e)
        assert np.allclose(got["plain"], info._transfer_kraskov(x, y, k, 0)) and np.allclose(got["dce"], info._transfer_kraskov(x, y, k, window))
    mixed = np.array([[1, 1, 1 + i % 2, 1, 1, 1, 1, 1] for i in range(5)], float)
    want = np.where(np.arange(5) % 2, info._transfer_kraskov(x, y, 2, 0), info._transfer_kraskov(x, y, 1, 0))
    assert np.allclose(info.transfer_histories(x, y, mixed)["plain"], want)


def test_rows_and_nulls(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    for t in range(1, 80):
        x[t] += 0.9 * x[t - 1]
    y = 0.9 * np.roll(x, 1) + 0.3 * rng.normal(size=80)
    gap = y.copy()
    series = {"s": {"x": x, "y": y, "flat": np.ones(80)}, "g": {"x": x, "y": gap}}
    rows = [(s, k, t, float(v)) for s, m in series.items() for k, c in m.items() for t, v in enumerate(c) if (s, k, t) != ("g", "y", 40)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in info.spi_te_kraskov_auto(panel).collect()}
    a, b = "te_kraskov_NN-4_k-max-10_tau-max-4", "te_kraskov_NN-4_DCE_k-max-10_tau-max-4"
    assert len(got) == 2 * 8
    assert got[a, "s", "x", "y"] > got[a, "s", "y", "x"]
    assert got[a, "s", "x", "flat"] is None and got[b, "g", "x", "y"] is None
    z = {k: ((v - v.mean()) / v.std(ddof=1))[None] for k, v in (("x", x), ("y", y))}
    h = {k: info.best_history(v) for k, v in z.items()}
    e = np.array([[h[s][f"{c}{w}"][0] for w in ("", "_dce") for s in ("x", "y") for c in ("k", "tau")]])
    assert got[a, "s", "x", "y"] == pytest.approx(info.transfer_histories(z["x"], z["y"], e)["plain"][0])
