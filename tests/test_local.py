"""Multiscale graph correlation and rings against their definitions with plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairspan.operators.windows import zscore_series
from pairspan.spi import local


def cases():
    rng = np.random.default_rng(2)
    x = rng.normal(size=24)
    ties = rng.integers(0, 4, size=(2, 20)).astype(float)
    return [(x, x**2), (x, rng.normal(size=24)), (x, 2 * x), (np.sin(np.arange(30)), np.cos(np.arange(30))), (ties[0], ties[1]), (ties[0], -ties[0])]


def plain_map(x, y):
    n = len(x)

    def side(v):
        d = [[abs(v[i] - v[j]) for j in range(n)] for i in range(n)]
        c = [[0.0 if i == j else d[i][j] - sum(d[k][j] for k in range(n)) / (n - 1) for j in range(n)] for i in range(n)]
        r = [[sorted({d[k][j] for k in range(n)}).index(d[i][j]) for j in range(n)] for i in range(n)]
        return c, r

    (a, ra), (b, rb) = side(x), side(y)
    kx, ky = max(map(max, ra)) + 1, max(map(max, rb)) + 1
    out = np.zeros((kx, ky))
    cells = [(i, j) for i in range(n) for j in range(n)]
    for k in range(kx):
        for l in range(ky):
            ea = sum(a[i][j] for i, j in cells if ra[i][j] <= k)
            eb = sum(b[i][j] for i, j in cells if rb[i][j] <= l)
            cov = sum(a[i][j] * b[j][i] for i, j in cells if ra[i][j] <= k and rb[j][i] <= l) - ea * eb / n**2
            va = sum(a[i][j] * a[j][i] for i, j in cells if ra[i][j] <= k and ra[j][i] <= k) - ea**2 / n**2
            vb = sum(b[i][j] * b[j][i] for i, j in cells if rb[i][j] <= l and rb[j][i] <= l) - eb**2 / n**2
            if va > 1e-9 and vb > 1e-9 and (k and l or min(kx, ky) == 1):
                out[k, l] = min(1, max(-1, cov / math.sqrt(va * vb)))
    return out


def plain_rings(x, y):
    n, total = len(x), 0.0
    for i in range(n):
        for j in range(n):
            if i != j:
                t = [[0, 0], [0, 0]]
                for k in range(n):
                    if k not in (i, j):
                        t[int(abs(x[i] - x[k]) > abs(x[i] - x[j]))][int(abs(y[i] - y[k]) > abs(y[i] - y[j]))] += 1
                (a, b), (c, d) = t
                den = (a + b) * (c + d) * (a + c) * (b + d)
                total += (n - 2) * (b * c - a * d) ** 2 / den if den else 0.0
    return total


def plain_region(on):
    best, seen = set(), set()
    for cell in zip(*np.nonzero(on), strict=True):
        if cell in seen:
            continue
        todo, part = [cell], {cell}
        while todo:
            i, j = todo.pop()
            for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= c[0] < on.shape[0] and 0 <= c[1] < on.shape[1] and on[c] and c not in part:
                    part.add(c)
                    todo.append(c)
        seen |= part
        if len(part) > len(best):
            best = part
    return best


@pytest.mark.parametrize("k", range(6))
def test_map_and_rings_equal_plain_loops(k):
    x, y = cases()[k]
    assert np.allclose(local.correlation_map(x, y), plain_map(x, y), atol=1e-9)
    assert local.rings(x[None], y[None])["v"][0] == pytest.approx(plain_rings(x, y))


@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_largest_region(rows):
    on = np.array(rows)
    got = set(zip(*(a.tolist() for a in np.nonzero(local.largest_region(on))), strict=True))
    assert got == {(int(i), int(j)) for i, j in plain_region(on)}


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_dominance_counts(points):
    u, v = (np.array(c)[None] for c in zip(*points, strict=True))
    assert local.dominated(u, v)[0].tolist() == [sum(a <= c and b <= d for a, b in points) for c, d in points]


def test_noise_level_by_simulation():
    rng = np.random.default_rng(0)
    n = 20
    a = n * (n - 3) / 4 - 0.5
    draws = 2 * rng.beta(a, a, 2_000_000) - 1
    assert local.noise_level(n) == pytest.approx(np.quantile(draws, 1 - 0.02 / n), abs=0.01)


def test_values_and_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=40)
    series = {"x": x, "same": 3 * x, "square": x**2, "apart": rng.normal(size=40), "flat": np.ones(40)}
    rows = [("s", k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {}
    for fn in (local.spi_mgc, local.spi_mgcx, local.spi_hhg):
        got |= {(r.spi, r.node_from, r.node_to): r.value for r in fn(panel).collect()}
    assert got["mgc", "same", "x"] == pytest.approx(1.0) and got["mgc", "square", "x"] > 0.3 > abs(got["mgc", "apart", "x"])
    assert got["hhg", "same", "x"] > got["hhg", "square", "x"] > got["hhg", "apart", "x"]
    assert got["mgc", "flat", "x"] is None and got["hhg", "flat", "x"] is None and got["mgcx_maxlag-1", "flat", "x"] is None
    z = {k: (s - s.mean()) / s.std(ddof=1) for k, s in series.items() if k != "flat"}
    lagged = local.multiscale(z["apart"], z["x"]) + local.multiscale(z["apart"][:-1], z["x"][1:]) * 39 / 40
    assert got["mgcx_maxlag-1", "apart", "x"] == pytest.approx(lagged)


def test_pairs_side_by_side_equal_single_pairs():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 12, 30)).round(1)
    y[:6] = (x[:6] + y[:6]).round(1)
    y[6] = np.where(np.arange(30) < 2, 1.0, 0.0)  # constant from a later step on
    whole = local.lagged_graph_correlation(x, y)
    for k in range(12):
        one = [local.multiscale(x[k, : 30 - l], y[k, l:]) * (30 - l) / 30 for l in range(11)]
        assert np.allclose([whole["m1"][k], whole["m10"][k]], [sum(one[:2]), sum(one)], atol=1e-12, equal_nan=True)
    assert np.isnan(whole["m10"][6]) and np.allclose(local.rings(x, y)["v"], [local.rings(x[k : k + 1], y[k : k + 1])["v"][0] for k in range(12)])
    one = local.dominated(*rng.integers(0, 9, (2, 3, 150)).astype(float))  # more places than a word has bits
    assert one.shape == (3, 150) and one.min() >= 1
    calls = []
    local._sums_to, plain = lambda *a: calls.append(1) or plain(*a), local._sums_to
    try:
        local.lagged_graph_correlation(x, y)
    finally:
        local._sums_to = plain
    assert len(calls) == 5 * 11  # not for each pair again
