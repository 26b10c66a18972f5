"""Integrated information of two channels, one step ahead, under a Gaussian model.

Spark sums the moments of both channels at two consecutive steps; the optima are then found for all pairs of a batch at once. Let x be the past and y the present of both channels. *Star*: the information
that x carries about y, less what a decoder gets that knows each channel's own past only, at its best exponent. *Geometric*: half the log ratio of the residual
determinants without and with influence across channels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats

GOLDEN = (math.sqrt(5) - 1) / 2
NAMES = ["phi_star_t-1_norm-0", "phi_star_t-1_norm-1", "phi_Geo_t-1_norm-0", "phi_Geo_t-1_norm-1"]
SIDES = ("x0", "y0", "x1", "y1")
PRODUCTS = [(a, b) for k, a in enumerate(SIDES) for b in SIDES[k:]]


def step_moments(panel: DataFrame) -> DataFrame:
    """``n``, sums and sums of products of the four values at each step and the next; steps that lack one are left out."""
    a, n = grid_arrays(panel), F.size("x") - 1
    cols = [F.slice(c, F.lit(first), n).alias(f"{c}{first - 1}") for first in (1, 2) for c in ("x", "y")]
    pts = a.where(F.size("x") > 1).select(*PAIR, *cols).select(*PAIR, F.inline(F.arrays_zip(*SIDES))).dropna(subset=list(SIDES))
    sums = [F.sum(c).alias(c) for c in SIDES] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in PRODUCTS]
    return pts.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), *sums)


def _det(m: np.ndarray) -> np.ndarray:
    return m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0]


def mismatched_information(beta: np.ndarray, past: np.ndarray, now: np.ndarray, own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Information of a decoder with the channels' own slopes ``own`` (b, 2) and residual variances ``left`` (b, 2), raised to ``beta``; concave in it."""
    inverse = np.linalg.inv(past)
    m = inverse + (beta[:, None] * own**2 / left)[:, :, None] * np.eye(2)
    lead = (beta[:, None] * own / left)[:, :, None] * np.eye(2)
    k = (beta[:, None] / left)[:, :, None] * np.eye(2) - lead @ np.linalg.inv(m) @ lead
    return 0.5 * np.log(_det(past) * _det(m)) + 0.5 * np.einsum("bij,bji->b", k, now) - beta


def star(past: np.ndarray, now: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Information of the whole less the best that a decoder of parts gets. ``cross`` is E now past'."""
    whole = 0.5 * np.log(_det(now) / _det(now - cross @ np.linalg.inv(past) @ np.swapaxes(cross, 1, 2)))
    var = np.einsum("bii->bi", past)
    own = np.einsum("bii->bi", cross) / var
    left = np.einsum("bii->bi", now) - own**2 * var
    worth = lambda beta: mismatched_information(beta, past, now, own, left)
    high = np.ones(len(past))
    for _ in range(40):  # concave: past the optimum once the value falls
        rising = worth(high) > worth(high / 2)
        if not rising.any():
            break
        high = np.where(rising, 2 * high, high)
    low = np.zeros(len(past))
    for _ in range(90):
        width = GOLDEN * (high - low)
        a, b = high - width, low + width
        up = worth(a) < worth(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return whole - np.maximum(worth((low + high) / 2), 0)


def geometric(past: np.ndarray, now: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Half the log ratio of the residual determinants; own slopes are solved for and weights renewed in turn, which never raises the determinant."""
    slope = cross @ np.linalg.inv(past)
    full = now - slope @ np.swapaxes(cross, 1, 2)
    own = np.einsum("bii->bi", cross) / np.einsum("bii->bi", past)
    for _ in range(500):
        gap = slope - own[:, :, None] * np.eye(2)
        cov = full + gap @ past @ np.swapaxes(gap, 1, 2)
        weight = np.linalg.inv(cov)
        new = np.linalg.solve(weight * past, np.einsum("bij,bji->bi", weight, slope @ past)[:, :, None])[:, :, 0]
        moved = np.abs(new - own).max(initial=0)
        own = new
        if moved < 1e-12:
            break
    gap = slope - own[:, :, None] * np.eye(2)
    return 0.5 * np.log(_det(full + gap @ past @ np.swapaxes(gap, 1, 2)) / _det(full))


def integrated(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All four values from moments; NaN where a channel is constant or the pair's past or future is fully determined."""
    n, mean = m["n"], np.stack([m[c] / m["n"] for c in SIDES], axis=1)
    cov = np.zeros((len(n), 4, 4))
    for a, b in PRODUCTS:
        i, j = SIDES.index(a), SIDES.index(b)
        cov[:, i, j] = cov[:, j, i] = m[f"{a}_{b}"] / n - mean[:, i] * mean[:, j]
    ok = np.flatnonzero(np.linalg.eigvalsh(cov)[:, 0] > 1e-9)
    out = {k: np.full(len(n), np.nan) for k in NAMES}
    if len(ok):
        past, now, cross = cov[ok, :2, :2], cov[ok, 2:, 2:], cov[ok, 2:, :2]
        entropy = 0.5 * np.log(2 * math.pi * math.e * np.einsum("bii->bi", past)).min(axis=1)
        for name, value in (("phi_star", star(past, now, cross)), ("phi_Geo", geometric(past, now, cross))):
            out[f"{name}_t-1_norm-0"][ok] = value
            out[f"{name}_t-1_norm-1"][ok] = np.where(entropy > 0, value / np.where(entropy > 0, entropy, 1), np.nan)
    return out


def spi_phi(panel: DataFrame) -> DataFrame:
    """Integrated information, star and geometric, plain and over the smaller entropy of the two pasts."""
    names = ["n", *SIDES, *[f"{a}_{b}" for a, b in PRODUCTS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = integrated({k: b[k].to_numpy(zero_copy_only=False).astype(float) for k in names})
            yield pa.RecordBatch.from_arrays([b[k] for k in PAIR] + [pa.array(got[k], from_pandas=True) for k in NAMES], names=[*PAIR, *NAMES])

    schema = "sample_id string, node_from string, node_to string, " + ", ".join(f"`{k}` double" for k in NAMES)
    return melt_stats(step_moments(panel).mapInArrow(run, schema), {k: F.col(f"`{k}`") for k in NAMES})
