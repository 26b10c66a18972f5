"""Least-determinant covariances against all subsets, with planted outliers, over blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairspan.operators.windows import zscore_series
from pairspan.spi import robust


def panel_of(spark, samples):
    rows = [(s, f"c{k}", t, float(v)) for s, m in samples.items() for t, r in enumerate(m) for k, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "sample_id string, node string, t int, z double")


def test_quantiles():
    # fixed values: chi-square tables
    for q, p, want in ((0.5, 2, 1.386294), (0.975, 2, 7.377759), (0.975, 5, 12.832502), (0.5, 10, 9.341818), (0.975, 1, 5.023886), (0.975, 100, 129.561197)):
        assert robust.chi2_quantile(q, p) == pytest.approx(want, abs=1e-5)


def test_equals_all_subsets_of_tiny_samples(spark):
    rng = np.random.default_rng(0)
    samples = {f"s{k}": rng.normal(size=(9 + k % 3, 2)) for k in range(6)}
    blocks = robust.step_blocks(panel_of(spark, samples), 4).cache()
    assert blocks.groupBy("sample_id").count().where("count > 1").count() == 6
    got = {r.sample_id: r for r in robust.least_determinant(blocks, 60).collect()}
    for s, x in samples.items():
        h = (len(x) + 3) // 2
        best = min((np.linalg.det(np.cov(x[list(c)].T, bias=True)), c) for c in combinations(range(len(x)), h))
        assert got[s].logdet == pytest.approx(np.log(best[0]), abs=1e-8)
        assert np.allclose(got[s].mean, x[list(best[1])].mean(0))


def test_outliers_and_blocks_and_gaps(spark):
    rng = np.random.default_rng(1)
    clean = rng.normal(size=(200, 3)) @ np.array([[1, 0.6, 0], [0, 0.8, 0.3], [0, 0, 1.0]])
    planted = clean.copy()
    planted[::5] = rng.normal(size=(40, 3)) + [60, -60, 60]
    gap = clean.copy()
    gap[3, 0] = np.nan
    want = np.cov(np.delete(planted, np.s_[::5], axis=0).T, bias=True)
    for block in (4096, 64):
        rows = robust.spi_robust(panel_of(spark, {"clean": clean, "planted": planted, "gap": gap, "short": clean[:3]}), 10, block).collect()
        got = {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in rows}
        assert len(got) == len(rows) == 4 * 3 * 8
        for i in range(3):
            for j in range(i + 1, 3):
                assert got["cov_MinCovDet", "planted", f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=0.15)
                assert got["cov_EllipticEnvelope", "planted", f"c{i}", f"c{j}"] == got["cov_MinCovDet", "planted", f"c{i}", f"c{j}"]
                assert got["prec-sq_MinCovDet", "gap", f"c{i}", f"c{j}"] == pytest.approx(got["prec_MinCovDet", "gap", f"c{i}", f"c{j}"] ** 2)
                assert got["cov_MinCovDet", "short", f"c{i}", f"c{j}"] is None
        if block == 4096:
            first = got
    assert all(got[k] == (pytest.approx(v, abs=1e-9) if v is not None else None) for k, v in first.items())


def test_singular_half_and_constant_channel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    x[:30, 1] = 0.0  # most steps lie in a plane
    y = rng.normal(size=(40, 3))
    y[:, 2] = 5.0
    panel = zscore_series(panel_of(spark, {"plane": x, "const": y}).withColumnRenamed("z", "signal"))
    got = {(r.sample_id, r.node_from, r.node_to): r.value for r in robust.spi_robust(panel, 8).where(F.col("spi") == "cov_MinCovDet").collect()}
    assert got["plane", "c0", "c1"] is None and got["plane", "c0", "c2"] is None
    assert got["const", "c0", "c1"] is not None and got["const", "c0", "c2"] is None


def test_samples_of_one_block_need_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    samples = {f"s{k}": rng.normal(size=(9 + k % 3, 2)) for k in range(6)} | {"wide": rng.normal(size=(30, 4)), "short": rng.normal(size=(3, 2))}
    panel = panel_of(spark, samples)
    apart = {r.sample_id: np.array(r.prec) for r in robust.robust_covariances(panel, 60, 4).collect()}

    def rounds(*_):
        raise AssertionError("rounds over blocks")

    monkeypatch.setattr(robust, "least_determinant", rounds)
    whole = {r.sample_id: np.array(r.prec) for r in robust.robust_covariances(panel, 60, 4096).collect()}
    assert set(whole) == set(apart) == set(samples) - {"short"}
    assert all(np.allclose(whole[s], apart[s], rtol=1e-9, atol=0) for s in whole)
