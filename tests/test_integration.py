"""Integrated information: zero for independent parts, equal to grid searches, rows and nulls."""

from __future__ import annotations

import numpy as np
import pytest

from pairspan.operators.windows import zscore_series
from pairspan.spi import integration as it


def process(slope, noise):
    """Covariances of past, present and across of a stationary process."""
    cov = np.eye(2)
    for _ in range(5000):
        cov = slope @ cov @ slope.T + noise
    return cov[None], cov[None], (slope @ cov)[None]


COUPLED = process(np.array([[0.5, 0.3], [-0.2, 0.4]]), np.array([[1, 0.3], [0.3, 0.7]]))


def test_independent_parts_have_none():
    parts = process(np.diag([0.6, -0.4]), np.diag([1.0, 2.0]))
    assert it.star(*parts)[0] == pytest.approx(0, abs=1e-9) and it.geometric(*parts)[0] == pytest.approx(0, abs=1e-12)
    assert it.star(*COUPLED)[0] > 0.01 and it.geometric(*COUPLED)[0] > 0.01


def test_star_equals_a_grid_and_a_simulation():
    past, now, cross = COUPLED
    own, var = np.diag(cross[0]) / np.diag(past[0]), np.diag(past[0])
    left = np.diag(now[0]) - own**2 * var
    grid = np.linspace(0.001, 4, 20_001)
    many = [np.repeat(m, len(grid), axis=0) for m in (past, now)]
    best = it.mismatched_information(grid, *many, np.tile(own, (len(grid), 1)), np.tile(left, (len(grid), 1))).max()
    whole = 0.5 * np.log(np.linalg.det(now[0]) / np.linalg.det(now[0] - cross[0] @ np.linalg.inv(past[0]) @ cross[0].T))
    assert it.star(*COUPLED)[0] == pytest.approx(whole - best, abs=1e-7)
    # the definition by sampling: mean log q(y|x)^beta less that of its mean over x
    rng, beta = np.random.default_rng(0), 0.8
    joint = np.block([[past[0], cross[0].T], [cross[0], now[0]]])
    z = rng.multivariate_normal(np.zeros(4), joint, 4000)
    other = rng.multivariate_normal(np.zeros(2), past[0], 4000)
    log_q = lambda x, y: (-0.5 * (y - own * x) ** 2 / left - 0.5 * np.log(2 * np.pi * left)).sum(-1)
    first = beta * log_q(z[:, :2], z[:, 2:]).mean()
    second = np.mean([np.log(np.exp(beta * log_q(other, y)).mean()) for y in z[:, 2:]])
    value = it.mismatched_information(np.array([beta]), past, now, own[None], left[None])[0]
    assert value == pytest.approx(first - second, abs=0.03)


def test_geometric_equals_a_grid():
    past, now, cross = COUPLED
    slope = cross[0] @ np.linalg.inv(past[0])
    full = now[0] - slope @ cross[0].T

    def ratio(a, b):
        gap = slope - np.diag([a, b])
        return 0.5 * np.log(np.linalg.det(full + gap @ past[0] @ gap.T) / np.linalg.det(full))

    center = np.diag(cross[0]) / np.diag(past[0])
    best = min(ratio(center[0] + a, center[1] + b) for a in np.linspace(-0.6, 0.6, 121) for b in np.linspace(-0.6, 0.6, 121))
    assert it.geometric(*COUPLED)[0] <= best + 1e-12 and it.geometric(*COUPLED)[0] == pytest.approx(best, abs=2e-4)


def test_rows_moments_and_nulls(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(300, 2))
    for t in range(1, 300):
        z[t] += np.array([[0.5, 0.3], [-0.2, 0.4]]) @ z[t - 1]
    odd = np.column_stack([z[:, 0], np.ones(300), z[:, 0]])
    gap = z.copy()
    gap[10, 1] = np.nan
    samples = {"a": z, "odd": odd, "gap": gap, "short": z[:2]}
    rows = [(s, f"c{k}", t, float(v)) for s, m in samples.items() for t, r in enumerate(m) for k, v in enumerate(r) if not np.isnan(v)]
    panel = zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double"))
    got = {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in it.spi_phi(panel).collect()}
    x = (z - z.mean(0)) / z.std(0, ddof=1)
    joint = np.cov(np.column_stack([x[:-1], x[1:]]).T, bias=True)
    parts = joint[None, :2, :2], joint[None, 2:, 2:], joint[None, 2:, :2]
    assert got["phi_star_t-1_norm-0", "a", "c0", "c1"] == pytest.approx(it.star(*parts)[0], abs=1e-9)
    assert got["phi_Geo_t-1_norm-0", "a", "c0", "c1"] == pytest.approx(it.geometric(*parts)[0], abs=1e-9)
    entropy = 0.5 * np.log(2 * np.pi * np.e * np.diag(joint)[:2]).min()
    assert got["phi_Geo_t-1_norm-1", "a", "c0", "c1"] == pytest.approx(it.geometric(*parts)[0] / entropy, abs=1e-9)
    assert got["phi_star_t-1_norm-0", "gap", "c0", "c1"] == pytest.approx(got["phi_star_t-1_norm-0", "a", "c0", "c1"], abs=0.05)
    assert got["phi_star_t-1_norm-0", "odd", "c0", "c2"] is None
    assert got.get(("phi_star_t-1_norm-0", "short", "c0", "c1")) is None
