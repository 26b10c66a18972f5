"""Numpy helpers against direct definitions."""

import numpy as np
import pytest

from pairspan.functions import neighbours as nb
from pairspan.functions.svm import fit_classes, fit_pair, vote
from pairspan.spi import basic, causal, distance, infotheory, misc, spectral

rng = np.random.default_rng(3)
X, Y = rng.normal(size=(3, 24)), rng.normal(size=(3, 24))
X[1, :10] = 0.0  # ties


def test_kendall():
    def tau(x, y):
        s = [np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(24) for j in range(i)]
        nx = sum(x[i] != x[j] for i in range(24) for j in range(i))
        ny = sum(y[i] != y[j] for i in range(24) for j in range(i))
        return sum(s) / np.sqrt(nx * ny)

    assert np.allclose(basic.kendall_tau(X, Y)["tau"], [tau(x, y) for x, y in zip(X, Y)])


@pytest.mark.parametrize("kernel", ["distance", "gaussian"])
def test_dependence(kernel):
    def table(v):
        d = np.abs(v[:, None] - v[None])
        return d if kernel == "distance" else np.exp(-(d**2) / (2 * np.median(d[np.triu_indices(24, 1)]) ** 2))

    def both(x, y):
        a, b = table(x), table(y)
        h = np.eye(24) - 1 / 24
        ca, cb = h @ a @ h, h @ b @ h
        out = [(ca * cb).sum() / np.sqrt((ca**2).sum() * (cb**2).sum())]
        u = []
        for m in (a, b):
            m = m - np.diag(np.diag(m))
            w = m - m.sum(0) / 22 - m.sum(1)[:, None] / 22 + m.sum() / (23 * 22)
            u.append(w - np.diag(np.diag(w)))
        return [*out, (u[0] * u[1]).sum() / np.sqrt((u[0] ** 2).sum() * (u[1] ** 2).sum())]

    fn = distance.distance_correlation if kernel == "distance" else distance.kernel_dependence
    got = fn(X, Y)
    want = np.array([both(x, y) for x, y in zip(X, Y)])
    assert np.allclose(got["biased"], want[:, 0]) and np.allclose(got["unbiased"], want[:, 1])


def test_median_gap():
    for v in (X[0], X[1], X[0][:7]):
        d = np.abs(v[:, None] - v[None])[np.triu_indices(len(v), 1)]
        assert distance.median_gap(v) == pytest.approx(np.median(d))


@pytest.mark.parametrize("constraint", ["none", "sakoe", "itakura"])
def test_alignments(constraint):
    n = 24

    def allowed(i, j):
        return bool(distance._allowed(np.array([i]), np.array([j]), n, constraint)[0])

    for x, y in zip(X, Y):
        dtw, soft, lcss = (np.full((n + 1, n + 1), v) for v in (np.inf, np.inf, 0.0))
        dtw[0, 0] = soft[0, 0] = 0.0
        for i in range(n):
            for j in range(n):
                c = (x[i] - y[j]) ** 2
                near = abs(x[i] - y[j]) <= 1 and allowed(i, j)
                lcss[i + 1, j + 1] = lcss[i, j] + 1 if near else max(lcss[i, j + 1], lcss[i + 1, j])
                if allowed(i, j):
                    prev = [dtw[i, j + 1], dtw[i + 1, j], dtw[i, j]]
                    dtw[i + 1, j + 1] = c + min(prev)
                    prev = np.array([soft[i, j + 1], soft[i + 1, j], soft[i, j]])
                    if np.isfinite(prev).any():
                        soft[i + 1, j + 1] = c - np.log(np.exp(-prev).sum())
        one = (x[None], y[None], constraint)
        assert distance.dtw(*one)[0] == pytest.approx(np.sqrt(dtw[n, n]))
        assert distance.soft_dtw(*one)[0] == pytest.approx(soft[n, n])
        assert distance.lcss(*one)[0] == pytest.approx(lcss[n, n] / n)


def test_identical_series_align_at_no_cost():
    assert np.allclose(distance.dtw(X, X), 0) and np.allclose(distance.lcss(X, X), 1)


def test_neighbours_and_blocks(monkeypatch):
    v = nb.embed(X, Y, [("x", 0), ("y", 1)], 1)
    want = []
    for p in v:
        d = np.abs(p[:, None] - p[None]).max(axis=2)
        np.fill_diagonal(d, np.inf)
        want.append(np.sort(d, axis=1)[:, 3])
    assert np.allclose(nb.kth_distance(v, 4), want)
    monkeypatch.setattr("pairspan.functions.batches.CELLS", 100)  # one row at a time
    assert np.allclose(nb.kth_distance(v, 4), want)


def test_gaussian_entropy_terms():
    two = nb.entropy(np.stack([X, Y], axis=2), "gaussian")
    for k in range(3):
        assert two[k] == pytest.approx(0.5 * np.log((2 * np.pi * np.e) ** 2 * np.linalg.det(np.cov(X[k], Y[k]))))
    assert np.allclose(nb.digamma(np.array([1, 2, 5])), [-0.5772156649, 0.4227843351, 1.5061176684])


def test_direction_is_found():
    x = rng.normal(size=(4, 300))
    y = np.concatenate([rng.normal(size=(4, 1)), 0.8 * x[:, :-1] + 0.3 * rng.normal(size=(4, 299))], axis=1)
    for fn, key in ((infotheory.granger_best_history, "v"), (infotheory.transfer_kernel, "v"), (infotheory.symbolic_transfer, "k1")):
        assert (fn(x, y)[key] > fn(y, x)[key]).all()
    g, h = spectral.spectral_granger(x, y), spectral.spectral_granger(y, x)
    assert (g["mean|fmin-0_fmax-0-5|1"] > h["mean|fmin-0_fmax-0-5|1"]).all()


def test_cross_mapping_direct():
    dim, n = 2, 24

    def skill(x, y):
        m = n - dim + 1
        v = np.array([[y[i], y[i + 1]] for i in range(m)])
        out = []
        for size in sorted({m * q // 4 for q in (1, 2, 3, 4)}):
            pred = []
            for i in range(m):
                d = [(round(float(np.linalg.norm(v[i] - v[j])), 9), j) for j in range(size) if j != i]
                near = sorted(d)[: dim + 1]
                w = [np.exp(-a / near[0][0]) if near[0][0] > 0 else float(a == 0) for a, _ in near]
                pred.append(sum(a * x[j + 1] for a, (_, j) in zip(w, near)) / sum(w))
            out.append(np.corrcoef(pred, x[1:])[0, 1])
        return out

    assert np.allclose(causal._skills(X, Y)[dim], [skill(x, y) for x, y in zip(X, Y)], equal_nan=True)


def test_cubic_error():
    want = []
    for x, y in zip(X[[0, 2]], Y[[0, 2]]):
        x, y = ((v - v.min()) / np.ptp(v) for v in (x, y))
        want.append(((y - np.polyval(np.polyfit(x, y, 3), x)) ** 2).mean())
    assert np.allclose(causal.cubic_error(X[[0, 2]], Y[[0, 2]])["v"], want)


def test_cointegration():
    walk = np.cumsum(rng.normal(size=(6, 200)), axis=1)
    tied, free = walk + 0.2 * rng.normal(size=(6, 200)), np.cumsum(rng.normal(size=(6, 200)), axis=1)
    assert np.median(misc.johansen(walk, tied)["trace_0_1"]) > np.median(misc.johansen(walk, free)["trace_0_1"])
    assert np.median(misc.residual_unit_root(tied, walk)["c_aic"]) < np.median(misc.residual_unit_root(free, walk)["c_aic"])


def test_machine_separates_and_meets_conditions():
    x = np.concatenate([rng.normal(size=(20, 3)) + 3, rng.normal(size=(20, 3)) - 3])
    y = np.repeat([1.0, -1.0], 20)
    k = x @ x.T
    coef, offset = fit_pair(k, y)
    assert ((k @ coef + offset > 0) == (y > 0)).all()
    assert abs(coef.sum()) < 1e-9 and (np.abs(coef) <= 1 + 1e-12).all()
    assert (vote(k, *fit_classes(k, np.where(y > 0, "a", "b"))) == np.where(y > 0, "a", "b")).all()


def test_wavelet_is_the_direct_sum():
    got = spectral._morlet(X)[0]
    f, n = got["f"][2], X.shape[1]
    width = 6 / (2 * np.pi * f)
    gap = np.arange(n)[:, None] - np.arange(n)[None]
    wave = np.exp(-2j * np.pi * f * gap) * np.exp(-(gap**2) / (2 * width**2)) / np.sqrt(width)
    assert np.allclose(got["re"][2] + 1j * got["im"][2], wave @ X[0])


def test_sets_of_variables_share_distances():
    x, y = np.random.default_rng(6).normal(size=(2, 5, 20)).round(1)
    sets = [[("y", 0), ("y", 1), ("x", 0)], [("y", 1), ("x", 0)], [("y", 1)]]
    for at in (250_000, 5 * 18 * 4):  # also in blocks of rows
        nb.row_blocks, plain = (lambda b, n, at=at: (slice(k, min(n, k + at // (b * n))) for k in range(0, n, at // (b * n))) if at < 1000 else [slice(0, n)]), nb.row_blocks
        try:
            got = nb.entropies(x, y, sets, 2)
        finally:
            nb.row_blocks = plain
        for kind, values in got.items():
            for v, value in zip(sets, values, strict=True):
                assert np.allclose(value, nb.entropy(nb.embed(x, y, v, 2), kind), atol=1e-12)


def test_equal_neighbours_and_repeated_series():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, (4, 16)).astype(float)
    square = (y[:, :, None] - y[:, None]) ** 2
    for (near, place), size in zip(causal._nearest(square, np.arange(16), [8, 16], 3), (8, 16), strict=True):
        d = np.sqrt(square).round(9)
        d[:, np.arange(16), np.arange(16)] = np.inf
        want = np.argsort(d[:, :, :size], axis=2, kind="stable")[:, :, :3]
        assert (place == want).all() and (near == np.take_along_axis(d, want, 2)).all()
    far = causal._nearest(square * 1e20, np.arange(16), [16], 3)[0][1]
    assert (far == want).all()
    x = rng.normal(size=(4, 16))
    whole = causal._skills(x, np.repeat(y[:1], 4, axis=0))
    for d, v in whole.items():
        assert np.allclose(v, [causal._skills(x[k : k + 1], y[:1])[d][0] for k in range(4)], equal_nan=True)
