"""Dependence of two series at the scale of neighbourhoods: multiscale graph correlation and the test of all rings.

Both look at the T x T distances of the two series of a pair, so a pair holds a few arrays of T x T numbers: series of some thousand steps are what one task can take. Pairs of one
length go side by side, in batches.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import map_arrays, row_blocks
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats, pair_arrays

LAGS = (1, 10)


def dense_ranks(d: np.ndarray) -> np.ndarray:
    """0-based rank of each distance among those of its last axis; equal ones share a rank."""
    order = np.argsort(d, axis=-1)
    in_order = np.take_along_axis(d, order, -1)
    up = np.zeros(d.shape, np.int64)
    np.cumsum(in_order[..., 1:] > in_order[..., :-1], axis=-1, out=up[..., 1:])
    out = np.empty_like(up)
    np.put_along_axis(out, order, up, -1)
    return out


def ranks_within(ranks: np.ndarray, part: slice) -> np.ndarray:
    """The dense ranks that the points of a span have among themselves, from those among all."""
    own = ranks[:, part, part]
    m, n, _ = own.shape
    at = own + ranks.shape[2] * np.arange(m * n).reshape(m, n, 1)
    there = np.zeros(m * n * ranks.shape[2], np.int8)
    there[at] = 1
    return np.cumsum(there.reshape(m * n, -1), axis=1, dtype=np.int64).ravel()[at] - 1


def _sums_to(weight: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """For each pair, sums of the weights whose ranks are at most each number below n, along one or two axes: cumulative sums of a histogram."""
    m, n, _ = weight.shape
    flat = np.arange(m).reshape(m, 1, 1)
    for r in ranks:
        flat = flat * n + r
    grid = np.bincount(flat.ravel(), weight.ravel(), m * n ** len(ranks)).reshape(m, *[n] * len(ranks))
    for axis in range(1, grid.ndim):
        np.cumsum(grid, axis=axis, out=grid)
    return grid


def _turned(v: np.ndarray) -> np.ndarray:
    return np.swapaxes(v, 1, 2)


class Side(NamedTuple):
    """What a map needs of one series: centred distances, their dense ranks along the last axis, and by rank their sum and spread."""

    centred: np.ndarray
    ranks: np.ndarray
    total: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, d: np.ndarray, ranks: np.ndarray) -> Side:
        n = d.shape[1]
        c = d - d.sum(axis=1, keepdims=True) / (n - 1)
        c[:, np.arange(n), np.arange(n)] = 0.0
        total = _sums_to(c, _turned(ranks))
        return cls(c, ranks, total, _sums_to(c * _turned(c), np.maximum(ranks, _turned(ranks))) - total**2 / n**2)


def correlation_maps(x: Side, y: Side, of_x: np.ndarray, of_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation of centred distances among each point's k nearest in x and l nearest in y, for all k and l, of many pairs; and how many k and l a pair has.

    A pair names its series by number, for a series stands in the pairs with all other channels. Cells beyond a pair's own k or l repeat the last ones.
    """
    n = x.ranks.shape[1]
    va, vb = x.spread[of_x], y.spread[of_y]
    cov = _sums_to(x.centred[of_x] * _turned(y.centred)[of_y], _turned(x.ranks)[of_x], y.ranks[of_y])
    cov -= x.total[of_x][:, :, None] * y.total[of_y][:, None] / n**2
    wide, high = (r.max(axis=(1, 2)) + 1 for r in (x.ranks, y.ranks))
    wide, high = wide[of_x], high[of_y]
    good_a, good_b = (v > 1e-12 * np.maximum(v[:, -1:], 1e-300) for v in (va, vb))
    scale = va[:, :, None] * vb[:, None]
    bad = ~(good_a[:, :, None] & good_b[:, None])
    scale[bad], cov[bad] = 1.0, 0.0
    cov /= np.sqrt(scale, out=scale)
    out = np.clip(cov, -1, 1, out=cov)
    many = np.minimum(wide, high) > 1  # a point alone has no neighbours
    out[many, 0], out[many, :, 0] = 0.0, 0.0
    return out, wide, high


def correlation_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The map of one pair."""
    one = np.zeros(1, int)
    out, wide, high = correlation_maps(*(Side.of(d, dense_ranks(d)) for d in (np.abs(v[None, :, None] - v[None, None]) for v in (x, y))), one, one)
    return out[0, : wide[0], : high[0]]


@functools.cache
def noise_level(n: int) -> float:
    """What the correlation of independent series exceeds in 0.02 / n of the cases: from a symmetric beta distribution, whose upper tail is integrated."""
    a = n * (n - 3) / 4 - 0.5
    if a <= 0:
        return 1.0
    share, lo, hi = 0.02 / n, 0.0, 1.0
    grid = np.linspace(0, 1, 200_001)
    with np.errstate(divide="ignore"):
        log_density = (a - 1) * np.log1p(-(grid**2))  # of 2 q - 1
    density = np.exp(log_density - log_density.max())
    tail = np.concatenate([np.cumsum((density[1:] + density[:-1])[::-1])[::-1], [0.0]])
    at = np.searchsorted(-tail, -2 * share * tail[0])
    lo, hi = grid[max(at - 1, 0)], grid[min(at, len(grid) - 1)]
    return float((lo + hi) / 2)


def largest_regions(on: np.ndarray) -> np.ndarray:
    """Cells of the largest region of neighbouring cells (above, below, left, right) of each map; the first of equal ones."""
    m, n, k = on.shape
    none = n * k
    out, left = np.zeros(on.shape, bool), np.arange(m)
    label = np.where(on, np.arange(none).reshape(n, k), none)
    while len(left):
        wide = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        around = np.minimum(label, np.minimum(np.minimum(wide[:, :-2, 1:-1], wide[:, 2:, 1:-1]), np.minimum(wide[:, 1:-1, :-2], wide[:, 1:-1, 2:])))
        new = np.where(on[left], around, none).reshape(len(left), none)
        new = np.take_along_axis(np.concatenate([new, np.full((len(left), 1), none)], axis=1), new, 1)  # the label of the label
        new = new.reshape(label.shape)
        rest = (new != label).any(axis=(1, 2))
        done = ~rest
        if done.any():
            got, own = new[done].reshape(-1, none), left[done]
            at = np.arange(len(own))[:, None] * (none + 1)
            counts = np.bincount((got + at).ravel(), minlength=len(own) * (none + 1)).reshape(len(own), none + 1)[:, :none]
            out[own] = on[own] & (got == counts.argmax(axis=1)[:, None]).reshape(-1, n, k)
        left, label = left[rest], new[rest]
    return out


def largest_region(on: np.ndarray) -> np.ndarray:
    """The region of one map."""
    return largest_regions(on[None])[0]


def _greatest(x: Side, y: Side, of_x: np.ndarray, of_y: np.ndarray) -> np.ndarray:
    """The greatest correlation in the largest region above the noise, if the region is large enough; else that of all points."""
    m, wide, high = correlation_maps(x, y, of_x, of_y)
    n = m.shape[1]
    value = m[:, -1, -1].copy()
    on = m > np.maximum(noise_level(n), value)[:, None, None]
    on &= (np.arange(n) < wide[:, None])[:, :, None] & (np.arange(n) < high[:, None])[:, None]
    least = np.ceil(0.02 * np.maximum(wide, high)) * np.minimum(wide, high)
    some = np.flatnonzero(on.sum(axis=(1, 2)) >= least)
    if len(some):
        region = largest_regions(on[some])
        best = np.where(region, m[some], -np.inf).max(axis=(1, 2))
        value[some] = np.where(region.sum(axis=(1, 2)) >= least[some], np.maximum(value[some], best), value[some])
    return value


def _by_lag(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """Multiscale correlation (lag, pair) of each x and the y some steps later; distances are ranked once for a series and all lags."""
    n = x.shape[1]
    (own_x, of_x), (own_y, of_y) = (np.unique(v, axis=0, return_inverse=True) for v in (x, y))
    dx, dy = (np.abs(v[:, :, None] - v[:, None]) for v in (own_x, own_y))
    rx, ry = dense_ranks(dx), dense_ranks(dy)
    out = np.full((lags, len(x)), np.nan)
    for lag in range(min(lags, n - 3)):
        early, late = slice(0, n - lag), slice(lag, n)
        good = np.flatnonzero((np.ptp(own_x[:, early], axis=1) > 0)[of_x] & (np.ptp(own_y[:, late], axis=1) > 0)[of_y])
        if len(good):
            sides = (Side.of(d[:, part, part], r if lag == 0 else ranks_within(r, part)) for d, r, part in ((dx, rx, early), (dy, ry, late)))
            out[lag, good] = _greatest(*sides, of_x[good], of_y[good])
    return out


def multiscale(x: np.ndarray, y: np.ndarray) -> float:
    return float(_by_lag(x[None], y[None], 1)[0, 0])


def graph_correlation(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    return {"v": _by_lag(x, y, 1)[0]}


def lagged_graph_correlation(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over lags of the correlation of x and later y, each by its share of the points."""
    n = x.shape[1]
    shares = (n - np.arange(max(LAGS) + 1)) / n
    by_lag = _by_lag(x, y, max(LAGS) + 1) * shares[:, None]
    return {f"m{most}": np.sum(by_lag[: most + 1], axis=0) for most in LAGS}


def _sorted(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of each row, and for each place of it the last one that is equal."""
    order = np.argsort(d, axis=1)
    in_order = np.take_along_axis(d, order, 1)
    n = d.shape[1]
    last = np.full(d.shape, n - 1)
    last[:, :-1] = np.where(in_order[:, 1:] > in_order[:, :-1], np.arange(n - 1), n - 1)
    return order, np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]


def _put(order: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty_like(v)
    np.put_along_axis(out, order, v, 1)
    return out


def _counts(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of each row, how many places of the row are at most as large in ``u``, in ``v`` and in both.

    The places up to one are a bit each, 64 to a word.
    """
    sides = [_sorted(d) for d in (u, v)]
    both = np.zeros(u.shape, np.int64)
    for w in range(-(-u.shape[1] // 64)):
        bits = []
        for order, last in sides:
            one = np.where(order // 64 == w, np.uint64(1) << (order % 64).astype(np.uint64), np.uint64(0))
            bits.append(_put(order, np.take_along_axis(np.cumsum(one, axis=1, dtype=np.uint64), last, 1)))
        both += np.bitwise_count(bits[0] & bits[1])
    in_u, in_v = (_put(order, last + 1) for order, last in sides)
    return in_u, in_v, both


def dominated(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each place of each row, how many places of the row are at most as large in both ``u`` and ``v``, itself included."""
    return _counts(u, v)[2]


def rings(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Sum over ordered pairs of points of the chi-square of the table: within the ring of the pair in x, in y, in both."""
    b, n = x.shape
    out = np.zeros(b)
    for rows in row_blocks(b, n):
        dx, dy = (np.abs(v[:, rows, None] - v[:, None]) for v in (x, y))
        in_x, in_y, both = (c.reshape(dx.shape) - 2.0 for c in _counts(dx.reshape(-1, n), dy.reshape(-1, n)))
        a12, a21, a22 = in_x - both, in_y - both, n - 2 - in_x - in_y + both
        den = in_x * (n - 2 - in_x) * in_y * (n - 2 - in_y)
        chi = np.where(den > 0, (n - 2) * (a12 * a21 - both * a22) ** 2 / np.where(den > 0, den, 1), 0.0)
        at = np.arange(rows.start, rows.stop)
        chi[:, at - rows.start, at] = 0.0
        out += chi.reshape(b, -1).sum(axis=1)
    return {"v": np.where((np.ptp(x, axis=1) == 0) | (np.ptp(y, axis=1) == 0) | (n < 4), np.nan, out)}


def spi_mgc(panel: DataFrame) -> DataFrame:
    return melt_stats(map_arrays(pair_arrays(panel), PAIR, ["x", "y"], graph_correlation, ["v"]), {"mgc": F.col("v")})


def spi_mgcx(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel), PAIR, ["x", "y"], lagged_graph_correlation, [f"m{k}" for k in LAGS])
    return melt_stats(m, {f"mgcx_maxlag-{k}": F.col(f"m{k}") for k in LAGS})


def spi_hhg(panel: DataFrame) -> DataFrame:
    return melt_stats(map_arrays(pair_arrays(panel), PAIR, ["x", "y"], rings, ["v"]), {"hhg": F.col("v")})
