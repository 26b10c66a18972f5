"""Sparse inverse covariances: optimality conditions, penalties by refitting, rows and nulls."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.functions import batches
from pairspan.operators.windows import zscore_series
from pairspan.spi import sparse


def sample(n, p, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, p)) @ (np.eye(p) + 0.4 * (rng.random((p, p)) < 0.3))


@pytest.mark.parametrize("p, penalty", [(2, 0.1), (5, 0.01), (8, 0.3), (12, 0.05)])
def test_optimality_conditions(p, penalty):
    s = np.stack([np.cov(sample(60, p, k).T, bias=True) for k in range(3)])
    w, prec = sparse.graphical_lasso(s, np.full(3, penalty))
    off = ~np.eye(p, dtype=bool)
    for k in range(3):
        assert np.allclose(w[k] @ prec[k], np.eye(p), atol=1e-5)
        assert np.allclose(np.diag(w[k]), np.diag(s[k]))
        gap = (w[k] - s[k])[off]
        assert np.abs(gap).max() <= penalty + 1e-6
        held = np.abs(prec[k][off]) > 1e-6
        assert np.allclose(gap[held], penalty * np.sign(prec[k][off][held]), atol=1e-5)


def test_a_large_penalty_parts_all_channels():
    s = np.cov(sample(50, 4, 1).T, bias=True)
    w, prec = sparse.graphical_lasso(s[None], np.array([10.0]))
    assert np.allclose(w[0], np.diag(np.diag(s))) and np.allclose(prec[0], np.diag(1 / np.diag(s)))


def folds_of(z, n_folds=5):
    part = np.floor(np.arange(len(z)) * n_folds / len(z)).astype(int)
    n = np.stack([np.full((z.shape[1],) * 2, (part == k).sum(), float) for k in range(n_folds)])
    sx = np.stack([np.tile(z[part == k].sum(0)[:, None], z.shape[1]) for k in range(n_folds)])
    return part, n, sx, np.stack([z[part == k].T @ z[part == k] for k in range(n_folds)])


def test_penalty_from_moments_equals_refitting():
    z = sample(70, 5, 4)
    part, n, sx, sxy = folds_of(z)
    whole = np.cov(z.T, bias=True)
    top = np.abs(whole[~np.eye(5, dtype=bool)]).max()
    scores = []
    for penalty in top * np.logspace(0, -2, sparse.PENALTIES):
        got = []
        for k in range(5):
            _, prec = sparse.graphical_lasso(np.cov(z[part != k].T, bias=True)[None], np.array([penalty]))
            got.append(np.linalg.slogdet(prec[0])[1] - np.trace(np.cov(z[part == k].T, bias=True) @ prec[0]))
        scores.append((np.mean(got), penalty))
    assert sparse.chosen_penalty(n, sx, sxy) == pytest.approx(max(scores)[1])


def test_rows_nulls_and_values(spark):
    z = sample(80, 4, 2)
    odd = z.copy()
    odd[:, 3] = 2.0  # constant
    gap = z.copy()
    gap[7, 1] = np.nan
    rows = [(s, f"c{k}", t, float(v)) for s, m in {"a": z, "odd": odd, "gap": gap}.items() for t, r in enumerate(m) for k, v in enumerate(r) if not np.isnan(v)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in sparse.spi_graphical_lasso(panel).collect()}
    assert len(got) == 3 * 6 * 8
    x = (z - z.mean(0)) / z.std(0, ddof=1)
    for name, penalty in (("GraphicalLasso", 0.01), ("GraphicalLassoCV", sparse.chosen_penalty(*folds_of(x)[1:]))):
        w, prec = sparse.graphical_lasso(np.cov(x.T, bias=True)[None], np.array([penalty]))
        for i in range(4):
            for j in range(i + 1, 4):
                assert got[f"cov_{name}", "a", f"c{i}", f"c{j}"] == pytest.approx(w[0, i, j], abs=1e-5)
                assert got[f"prec_{name}", "a", f"c{i}", f"c{j}"] == pytest.approx(prec[0, i, j], abs=1e-4)
                assert got[f"prec-sq_{name}", "a", f"c{i}", f"c{j}"] == pytest.approx(prec[0, i, j] ** 2, abs=1e-3)
    assert got["cov_GraphicalLasso", "odd", "c0", "c3"] is None and got["cov_GraphicalLasso", "odd", "c0", "c1"] is not None
    assert got["prec_GraphicalLassoCV", "gap", "c0", "c1"] is not None


def test_fold_moments_add_up(spark):
    z = sample(23, 3, 5)
    rows = [("a", f"c{k}", 100 + t, float(v)) for t, r in enumerate(z) for k, v in enumerate(r)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    x = (z - z.mean(0)) / z.std(0, ddof=1)
    _, n, sx, sxy = folds_of(x)
    for r in sparse.fold_moments(panel).collect():
        i, j = int(r.node_from[1]), int(r.node_to[1])
        assert (r.n, r.sx, r.sy, r.sxy) == (n[r.fold, i, j], pytest.approx(sx[r.fold, i, j]), pytest.approx(sx[r.fold, j, i]), pytest.approx(sxy[r.fold, i, j]))


def test_a_problem_does_not_depend_on_the_others():
    s = np.stack([np.cov(sample(30, 5, k).T, bias=True) for k in range(12)])
    penalty = np.geomspace(1e-3, 0.5, 12)
    w, prec = sparse.graphical_lasso(s, penalty)
    for k in range(12):
        one = sparse.graphical_lasso(s[k : k + 1], penalty[k : k + 1])
        assert np.abs(one[0][0] - w[k]).max() < 1e-14 and np.abs(one[1][0] - prec[k]).max() < 1e-12


def test_groups_that_span_batches_come_whole(spark):
    seen = batches.map_whole(spark.range(0, 50).selectExpr("cast(id % 3 as string) as k", "id"), ["k"], lambda t: t.group_by("k").aggregate([("id", "count")]).select(["k", "id_count"]), "k string, n long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, seen.collect())) == [("0", 17), ("1", 17), ("2", 16)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
