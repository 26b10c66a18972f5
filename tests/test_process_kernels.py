"""Kernels are taken apart once for all noises and partners."""

import numpy as np

from pairspan.spi import process


def test_one_decomposition_for_each_series(monkeypatch):
    rng = np.random.default_rng(4)
    own = rng.normal(size=(3, 12))
    own[2, 1:] = own[2, 0]  # a kernel of rank one
    x, y = np.repeat(own, [4, 1, 4], axis=0)[[0, 4, 1, 5, 2, 6, 3, 7, 8]], rng.normal(size=(9, 12))
    seen, real = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda k: seen.append(len(k)) or real(k))
    for kind in ("RBF", "DotProduct"):
        seen.clear()
        mean, best = process.fitted(x, y, kind)
        assert set(seen) == {3}
        for i in range(9):
            likely = []
            for k in process.kernels(x[i : i + 1], kind):
                for noise in process.NOISES:
                    full = k[0] + noise * np.eye(12)
                    weight = np.linalg.solve(full, y[i])
                    likely.append((-0.5 * y[i] @ weight - 0.5 * np.linalg.slogdet(full)[1] - 6 * np.log(2 * np.pi), k[0] @ weight))
            top = max(likely, key=lambda v: v[0])
            assert np.isclose(best[i], top[0]) and np.allclose(mean[i], top[1])


def test_median_gaps_of_short_series_by_table(monkeypatch):
    from pairspan.spi import distance

    rng = np.random.default_rng(8)
    for n in (2, 5, 30, 31):
        v = rng.normal(size=(6, n)).round(1)
        v[0] = v[0, 0]
        assert np.allclose(distance.median_gaps(v), [distance.median_gap(r) for r in v], atol=1e-15)
    monkeypatch.setattr(distance, "median_gap", lambda row: 1 / 0)
    distance.kernel_dependence(v, v[::-1])  # no bisection row by row
