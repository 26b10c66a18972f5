"""Elastic averages against direct alignments."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import barycentre as bc
from pairspan.spi import distance


def pairs(b=6, n=15, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(b, n)).cumsum(axis=1)
    return x, np.roll(x, 2, axis=1) + 0.3 * rng.normal(size=(b, n))


def all_paths(n):
    def go(i, j):
        if (i, j) == (n - 1, n - 1):
            yield [(i, j)]
        for p, q in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
            if p < n and q < n:
                for rest in go(p, q):
                    yield [(i, j), *rest]

    return list(go(0, 0))


def test_costs_and_shares_equal_all_paths():
    rng = np.random.default_rng(0)
    z, x = rng.normal(size=(2, 1, 4))
    cost = (z[0][:, None] - x[0][None]) ** 2
    totals = {tuple(p): sum(cost[c] for c in p) for p in all_paths(4)}
    least, shares = bc.alignment(z, x, False)
    assert least[0] == pytest.approx(min(totals.values()))
    assert {tuple(map(int, c)) for c in np.argwhere(shares[0])} == set(min(totals, key=totals.get))
    soft, shares = bc.alignment(z, x, True)
    weight = {p: math.exp(-t) for p, t in totals.items()}
    assert soft[0] == pytest.approx(-math.log(sum(weight.values())))
    want = np.zeros((4, 4))
    for p, w in weight.items():
        for c in p:
            want[c] += w / sum(weight.values())
    assert np.allclose(shares[0], want)


@pytest.mark.parametrize("soft", [False, True])
def test_cost_never_rises_and_rests(soft):
    x, y = pairs()
    z, costs = bc.barycentre(x, y, soft)
    for a, b in zip(costs, costs[1:], strict=False):
        assert (b <= a + 1e-9 * np.maximum(1, np.abs(a))).all()
    assert len(costs) < bc.ROUNDS
    run = distance.soft_dtw if soft else lambda a, b: distance.dtw(a, b) ** 2
    assert np.allclose(costs[-1], run(z, x) + run(z, y), atol=1e-6)
    if soft:  # the gradient is zero at rest
        step = 1e-5
        for t in (0, 7, 14):
            up, down = z.copy(), z.copy()
            up[:, t] += step
            down[:, t] -= step
            slope = (run(up, x) + run(up, y) - run(down, x) - run(down, y)) / (2 * step)
            assert np.abs(slope).max() < 0.05


def test_same_series_is_its_own_average():
    x, _ = pairs()
    assert np.allclose(bc.barycentre(x, x, False)[0], x) and np.allclose(bc.subgradient_barycentre(x, x), x)


def test_subgradient_lowers_the_cost():
    x, y = pairs()
    cost = lambda z: distance.dtw(z, x) ** 2 + distance.dtw(z, y) ** 2
    assert (cost(bc.subgradient_barycentre(x, y)) < cost((x + y) / 2)).all()


def test_rows_and_nulls(spark):
    x, y = pairs(1, 30)
    gap = y[0].copy()
    series = {"a": x[0], "b": y[0], "flat": np.ones(30)}
    rows = [("s", k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)] + [("g", "a", t, float(v)) for t, v in enumerate(x[0])] + [("g", "b", t, float(v)) for t, v in enumerate(gap) if t != 9]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in bc.spi_bary_elastic(panel).collect()}
    z = {k: (s - s.mean()) / s.std(ddof=1) for k, s in series.items() if k != "flat"}
    want = bc.averages(z["a"][None], z["b"][None])
    for k, v in want.items():
        assert got[f"bary_{k}", "s", "a", "b"] == pytest.approx(v[0], abs=1e-9)
        assert got[f"bary-sq_{k}", "s", "a", "b"] == pytest.approx(v[0] ** 2, abs=1e-9)
        assert got[f"bary_{k}", "s", "a", "flat"] is None and got[f"bary_{k}", "g", "a", "b"] is not None


@pytest.mark.parametrize("soft", [False, True])
def test_a_pair_does_not_depend_on_the_others(soft):
    x, y = pairs()
    whole = bc.barycentre(x, y, soft)[0]
    for k in range(len(x)):
        assert np.allclose(bc.barycentre(x[k : k + 1], y[k : k + 1], soft)[0][0], whole[k], atol=1e-12)


@pytest.mark.parametrize("soft", [False, True])
def test_sums_of_many_pairs_equal_single_alignments(soft, monkeypatch):
    rng = np.random.default_rng(3)
    z, x = rng.normal(size=(2, 40, 12)).round(1)
    z[:5] *= 30  # weights of these paths are too small for doubles
    run = bc.soft_sums if soft else bc.hard_sums
    cost, share, total = run(z.T.copy(), x.T.copy(), {})
    want, e = bc.alignment(z, x, soft)
    assert np.allclose(cost, want) and np.allclose(share.T, e.sum(axis=2)) and np.allclose(total.T, np.einsum("bij,bj->bi", e, x))
    # pairs that rest make room for others: far fewer steps than rounds of each group in turn
    monkeypatch.setattr(bc, "CELLS", 12 * 12 * 4)
    calls = []
    monkeypatch.setattr(bc, run.__name__, lambda *a: calls.append(a[0].shape[1]) or run(*a))
    many, costs = bc.barycentre(z, x, soft)
    assert np.mean(calls) > 8 and np.allclose(many, np.concatenate([bc.barycentre(z[k : k + 1], x[k : k + 1], soft)[0] for k in range(40)]))
    assert (np.diff(costs, axis=0) <= 1e-9 * np.maximum(1, np.abs(costs[:-1]))).all()
