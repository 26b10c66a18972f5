"""Multichannel autoregressions and spectral factors against direct solutions."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import multichannel as mc
from pairspan.spi import spectral

# one channel drives the second, the third is apart
COEF = np.array([[[0.5, 0, 0], [0.4, 0.3, 0], [0, 0, 0.6]], [[-0.3, 0, 0], [0.2, -0.2, 0], [0, 0, 0]]])


def simulated(n, coef=COEF, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n + 200, coef.shape[1]))
    for t in range(len(coef), len(z)):
        z[t] += sum(c @ z[t - 1 - k] for k, c in enumerate(coef))
    z = z[200:]
    return (z - z.mean(0)) / z.std(0, ddof=1)


def autocovariances(z, lags):
    return np.stack([z[l:].T @ z[: len(z) - l] / len(z) for l in range(lags + 1)])


def panel_of(spark, samples):
    rows = [(s, f"c{k}", t, float(v)) for s, z in samples.items() for t, row in enumerate(z) for k, v in enumerate(row) if not np.isnan(v)]
    return zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))


def test_recursion_equals_direct_solution():
    r = autocovariances(simulated(500), 6)
    models = mc.autoregressions(r)
    assert len(models) == 6
    for order, (coef, cov) in enumerate(models, 1):
        system = np.block([[r[l - k] if l >= k else r[k - l].T for l in range(1, order + 1)] for k in range(1, order + 1)])
        direct = np.stack(np.split(np.concatenate(list(r[1 : order + 1]), axis=1) @ np.linalg.inv(system), order, axis=1))
        assert np.allclose(coef, direct, atol=1e-10)
        assert np.allclose(cov, r[0] - sum(direct[k] @ r[k + 1].T for k in range(order)), atol=1e-10)


def test_singular_moments_have_no_model():
    z = simulated(300)
    twin = np.column_stack([z[:, 0], z[:, 0]])
    assert mc.best_order(autocovariances(twin, 3), 300) is None


def test_measures_equal_their_definitions():
    rng = np.random.default_rng(1)
    coef, cov = rng.normal(size=(2, 3, 3)) * 0.2, np.diag([0.5, 1.0, 2.0]) + 0.1
    got = mc.directed_measures(coef, cov)
    band = [f for f in mc.FREQUENCIES if f < 0.25]
    sums = {m: np.zeros((3, 3)) for m in mc.MEASURES}
    h_all = [np.linalg.inv(np.eye(3) - sum(c * np.exp(-2j * np.pi * f * (k + 1)) for k, c in enumerate(coef))) for f in mc.FREQUENCIES]
    full = sum(np.abs(h) ** 2 for h in h_all).sum(axis=1)
    for f in band:
        a = np.eye(3) - sum(c * np.exp(-2j * np.pi * f * (k + 1)) for k, c in enumerate(coef))
        h = np.linalg.inv(a)
        inv = np.linalg.inv(h @ cov @ h.conj().T)
        for i in range(3):
            for j in range(3):
                sums["dtf"][i, j] += abs(h[i, j]) / np.sqrt(sum(abs(h[i, k]) ** 2 for k in range(3)))
                sums["dcoh"][i, j] += np.sqrt(cov[j, j]) * abs(h[i, j]) / np.sqrt(sum(cov[k, k] * abs(h[i, k]) ** 2 for k in range(3)))
                sums["pdcoh"][i, j] += abs(a[i, j]) / np.sqrt(sum(abs(a[k, j]) ** 2 for k in range(3)))
                sums["gpdcoh"][i, j] += abs(a[i, j]) / np.sqrt(cov[i, i]) / np.sqrt(sum(abs(a[k, j]) ** 2 / cov[k, k] for k in range(3)))
                sums["ddtf"][i, j] += abs(h[i, j]) / np.sqrt(full[i]) * abs(inv[i, j]) / np.sqrt(inv[i, i].real * inv[j, j].real)
    for m in mc.MEASURES:
        assert np.allclose(got[f"{m}_multitaper_mean_fs-1_fmin-0_fmax-0-25"], sums[m] / len(band), atol=1e-10)


def test_small_blocks_of_frequencies_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    coef, cov = rng.normal(size=(2, 3, 3)) * 0.2, np.eye(3)
    whole = mc.directed_measures(coef, cov)
    monkeypatch.setattr(mc, "CELLS", 40)
    for k, v in mc.directed_measures(coef, cov).items():
        assert np.allclose(v, whole[k], atol=1e-12)


def test_lag_moments_over_blocks_and_gaps(spark):
    z = simulated(90)
    z[[5, 31, 32, 60], [0, 1, 1, 2]] = np.nan
    panel = panel_of(spark, {"s": z})
    values = {(r.node, r.t): r.z for r in panel.collect()}
    for block in (7, 32, 4096):
        for r in mc.lag_moments(panel, 6, block).collect():
            pairs = [(values[r.node_from, t - r.lag], values[r.node_to, t]) for t in range(90) if (r.node_to, t) in values and (r.node_from, t - r.lag) in values]
            assert r.n == len(pairs) and r.s == pytest.approx(sum(x * y for x, y in pairs))
    with pytest.raises(ValueError):
        mc.lag_moments(panel, 6, 6)


def test_direction_is_found_and_apart_is_zero(spark):
    z = simulated(3000)
    odd = z[:400].copy()
    odd[:, 2] = 1.0  # constant: no values
    short = z[:5]
    rows = mc.spi_directed(panel_of(spark, {"long": z, "odd": odd, "short": short}), block=512).collect()
    value = {(r.sample_id, r.spi, r.node_from, r.node_to): r.value for r in rows}
    assert len(value) == len(rows) == 3 * 6 * len(mc.STATS)
    direct = mc.directed_measures(*mc.best_order(autocovariances(z, mc.MAX_ORDER), 3000))
    for k in mc.STATS:
        for i in range(3):
            for j in range(3):
                if i != j:
                    assert value["long", k, f"c{j}", f"c{i}"] == pytest.approx(direct[k][i, j], abs=1e-8)
    for m in mc.MEASURES[:4]:
        k = f"{m}_multitaper_mean_fs-1_fmin-0_fmax-0-5"
        assert value["long", k, "c0", "c1"] > 0.3
        assert all(value["long", k, a, b] < 0.06 for a, b in (("c1", "c0"), ("c0", "c2"), ("c2", "c0"), ("c1", "c2"), ("c2", "c1")))
        assert value["odd", k, "c0", "c1"] > 0.3 and value["odd", k, "c0", "c2"] is None
        assert value["short", k, "c0", "c1"] is None


def test_factors_of_exact_spectra():
    f = np.arange(256) / 256
    for coef in (COEF[:, :2, :2], np.array([[[0.9, 0], [0.5, -0.7]]])):
        a = np.eye(2) - np.tensordot(np.exp(-2j * np.pi * f[:, None] * np.arange(1, len(coef) + 1)), coef, 1)
        h, noise = np.linalg.inv(a), np.array([[1, 0.3], [0.3, 2]])
        s = h @ noise @ np.conj(np.swapaxes(h, 1, 2))
        got, cov, done = spectral.factor_spectra(s[None])
        assert done.all() and np.allclose(got[0], h, atol=1e-6) and np.allclose(cov[0], noise, atol=1e-6)


def test_nonparametric_equals_parametric_on_long_series(spark):
    """Within 0.02 in the mean over a band at 20,000 steps."""
    z = simulated(20_000, COEF[:, :2, :2])
    got = spectral.nonparametric_granger(z[None, :, 0], z[None, :, 1])
    for way, (a, b) in {"ab": (0, 1), "ba": (1, 0)}.items():
        want = spectral.spectral_granger(z[None, :, a], z[None, :, b])
        for tag in spectral.BANDS:
            assert got[f"{way}|mean|{tag}"][0] == pytest.approx(want[f"mean|{tag}|None"][0], abs=0.02)


def test_nonparametric_rows_and_nulls(spark):
    z = simulated(120)
    twin, gap = z.copy(), z.copy()
    twin[:, 1] = twin[:, 0]
    gap[50, 1] = np.nan
    rows = spectral.spi_sgc_nonparametric(panel_of(spark, {"a": z, "twin": twin, "gap": gap})).collect()
    value = {(r.sample_id, r.spi, r.node_from, r.node_to): r.value for r in rows}
    k = "sgc_nonparametric_mean_fs-1_fmin-0_fmax-0-5"
    assert len(value) == len(rows) == 3 * 6 * 6
    assert value["a", k, "c0", "c1"] > value["a", k, "c1", "c0"]
    assert value["twin", k, "c0", "c1"] is None and value["twin", k, "c0", "c2"] is not None
    assert value["gap", k, "c1", "c0"] is None and value["gap", k, "c2", "c0"] is not None
    direct = spectral.nonparametric_granger(z[None, :, 0], z[None, :, 2])
    assert value["a", k, "c2", "c0"] == pytest.approx(direct["ba|mean|fmin-0_fmax-0-5"][0], abs=1e-6)


def test_samples_side_by_side_equal_single_models():
    rng = np.random.default_rng(12)
    r, n = [], np.array([40, 40, 200, 200, 12])
    for k, steps in enumerate(n):
        z = rng.normal(size=(3, steps))
        z[:, 2:] += 0.7 * z[:, :-2] * (k % 2)
        r.append(np.stack([z[:, lag:] @ z[:, : steps - lag].T / steps for lag in range(6)]))
    found = mc.best_orders(np.stack(r), n)
    for own, steps, got in zip(r, n, found, strict=True):
        models = [m for k, m in enumerate(mc.autoregressions(own), 1) if 2 * k * 3 <= steps]
        score = [steps * np.linalg.slogdet(cov)[1] + len(coef) * 9 * np.log(steps) for coef, cov in models]
        coef, cov = models[int(np.argmin(score))]
        assert np.allclose(got[0], coef) and np.allclose(got[1], cov)
    same = [k for k in range(len(n)) if len(found[k][0]) == len(found[0][0])]
    whole = mc.directed_measures(np.stack([found[k][0] for k in same]), np.stack([found[k][1] for k in same]))
    for k, at in enumerate(same):
        assert all(np.allclose(v[k], whole_v) for v, whole_v in zip(whole.values(), mc.directed_measures(*found[at]).values(), strict=True))
