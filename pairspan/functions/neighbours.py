"""Distances, neighbours and entropies of stacked point sets ``V[batch, point, dim]``."""

from __future__ import annotations

import numpy as np

from pairspan.functions.batches import row_blocks

EULER = 0.5772156649015329


def digamma(n: np.ndarray) -> np.ndarray:
    """psi of positive whole numbers: harmonic sum minus Euler's constant."""
    n = np.asarray(n, dtype=np.int64)
    top = int(n.max()) if n.size else 1
    table = np.concatenate([[np.nan, -EULER], -EULER + np.cumsum(1.0 / np.arange(1, max(top, 2)))])
    return table[n]


def embed(x: np.ndarray, y: np.ndarray, variables: list[tuple[str, int]], start: int) -> np.ndarray:
    """Columns ``x[t - lag]`` / ``y[t - lag]`` for t = start .. T-1."""
    src = {"x": x, "y": y}
    n = x.shape[1]
    return np.stack([src[s][:, start - lag : n - lag] for s, lag in variables], axis=2)


def max_norm(v: np.ndarray, rows: slice) -> np.ndarray:
    d = np.abs(v[:, rows, None, 0] - v[:, None, :, 0])
    for k in range(1, v.shape[2]):
        np.maximum(d, np.abs(v[:, rows, None, k] - v[:, None, :, k]), out=d)
    return d


def _barred(n: int, rows: slice, window: np.ndarray | int) -> np.ndarray:
    """True where two points are closer in time than the exclusion window (a point bars itself)."""
    apart = np.abs(np.arange(rows.start, rows.stop)[:, None] - np.arange(n)[None, :])
    return apart[None] <= np.asarray(window).reshape(-1, 1, 1)


def kth_distance(v: np.ndarray, k: int, window: np.ndarray | int = 0) -> np.ndarray:
    b, n, _ = v.shape
    out = np.full((b, n), np.nan)
    if n - 1 < k:
        return out
    for rows in row_blocks(b, n):
        d = max_norm(v, rows)
        d[np.broadcast_to(_barred(n, rows, window), d.shape)] = np.inf
        out[:, rows] = np.partition(d, k - 1, axis=2)[:, :, k - 1]
    return out


def count_below(v: np.ndarray, eps: np.ndarray, window: np.ndarray | int = 0) -> np.ndarray:
    """Points strictly closer than ``eps[i]``, outside the exclusion window.

    Both sides are compared at 9 digits: equal gaps of a tied series must stay equal.
    """
    b, n, _ = v.shape
    out = np.empty((b, n), dtype=np.int64)
    for rows in row_blocks(b, n):
        near = np.round(max_norm(v, rows), 9) < np.round(eps[:, rows, None], 9)
        out[:, rows] = (near & ~_barred(n, rows, window)).sum(axis=2)
    return out


def share_within(v: np.ndarray, width: float) -> np.ndarray:
    """Share of all points within ``width``, the point itself included."""
    b, n, _ = v.shape
    out = np.empty((b, n))
    for rows in row_blocks(b, n):
        out[:, rows] = (max_norm(v, rows) <= width).mean(axis=2)
    return out


def entropy(v: np.ndarray, estimator: str, k: int = 4, width: float = 0.5) -> np.ndarray:
    """Differential entropy per batch row: gaussian, kozachenko (k-th neighbour) or kernel (box)."""
    b, n, d = v.shape
    if estimator == "gaussian":
        c = v - v.mean(axis=1, keepdims=True)
        sign, logdet = np.linalg.slogdet(np.einsum("bni,bnj->bij", c, c) / (n - 1))
        ok = (sign > 0) & (logdet > -23.0 * d)
        return np.where(ok, 0.5 * (d * np.log(2 * np.pi * np.e) + logdet), np.nan)
    if estimator == "kozachenko":
        return _from_neighbours(kth_distance(v, k), k, d)
    return -np.log(share_within(v, width)).mean(axis=1)


def _from_neighbours(kth: np.ndarray, k: int, d: int) -> np.ndarray:
    eps = 2 * kth
    logs = np.where(eps > 0, np.log(np.where(eps > 0, eps, 1.0)), np.nan)
    return digamma(np.array([kth.shape[1]]))[0] - digamma(np.array([k]))[0] + d * np.nanmean(logs, axis=1)


def entropies(x: np.ndarray, y: np.ndarray, sets: list[list[tuple[str, int]]], start: int, k: int = 4, width: float = 0.5) -> dict[str, list[np.ndarray]]:
    """``entropy`` of several sets of delayed variables by neighbours and by boxes. Sets share the distances: one grows from the largest that it holds."""
    src = {"x": x, "y": y}
    b, n = x.shape
    m = n - start
    kth, share = ([np.full((b, m), np.nan) for _ in sets] for _ in range(2))
    by_size = sorted(range(len(sets)), key=lambda s: len(sets[s]))
    for rows in row_blocks(b, m):
        known: list[tuple[set, np.ndarray]] = []
        own = np.arange(rows.stop - rows.start)
        more = np.empty((b, len(own), m))
        for s in by_size:
            have, d = max(((v, d) for v, d in known if v <= set(sets[s])), key=lambda e: len(e[0]), default=(set(), None))
            d = np.zeros_like(more) if d is None else d.copy()
            for name, lag in sets[s]:
                if (name, lag) not in have:
                    late = src[name][:, start - lag : n - lag]
                    np.subtract(late[:, rows, None], late[:, None], out=more)
                    np.maximum(d, np.abs(more, out=more), out=d)
            known.append((set(sets[s]), d))
            share[s][:, rows] = (d <= width).sum(axis=2) / m
            if m - 1 >= k:
                np.copyto(more, d)
                more[:, own, own + rows.start] = np.inf
                more.partition(k - 1, axis=2)
                kth[s][:, rows] = more[:, :, k - 1]
    return {"kozachenko": [_from_neighbours(v, k, len(vs)) for v, vs in zip(kth, sets, strict=True)], "kernel": [-np.log(v).mean(axis=1) for v in share]}


def decorrelation_time(x: np.ndarray) -> np.ndarray:
    """First lag whose autocorrelation falls below 1/e."""
    b, n = x.shape
    c = x - x.mean(axis=1, keepdims=True)
    power = (c * c).sum(axis=1)
    out = np.full(b, n // 2)
    open_ = np.ones(b, dtype=bool)
    for lag in range(1, n // 2):
        low = open_ & ((c[:, :-lag] * c[:, lag:]).sum(axis=1) / power < np.exp(-1))
        out[low] = lag
        open_ &= ~low
        if not open_.any():
            break
    return out
