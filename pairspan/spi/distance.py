"""Pointwise distances, barycentres, distance correlation, kernels and elastic alignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, map_arrays, row_blocks
from pairspan.functions.numeric import ratio
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats, pair_arrays, pair_self_join


def spi_pdist(panel: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    d, size = F.abs(x - y), F.abs(x) + F.abs(y)
    m = (
        pair_self_join(panel)
        .where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy(*PAIR)
        .agg(
            F.sqrt(F.sum(d * d)).alias("euclidean"),
            F.sum(d).alias("cityblock"),
            (1 - ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y)))).alias("cosine"),
            F.max(d).alias("chebyshev"),
            F.sum(F.coalesce(ratio(d, size), F.lit(0.0))).alias("canberra"),
            ratio(F.sum(d), F.sum(F.abs(x + y))).alias("braycurtis"),
        )
    )
    return melt_stats(m, {f"pdist_{c}": F.col(c) for c in m.columns if c not in PAIR})


def spi_bary_euclidean(panel: DataFrame) -> DataFrame:
    mid = (F.col("x") + F.col("y")) / 2
    m = pair_self_join(panel).groupBy(*PAIR).agg(F.avg(mid).alias("a"), F.max(mid).alias("m"))
    a, b = F.col("a"), F.col("m")
    return melt_stats(m, {"bary_euclidean_mean": a, "bary_euclidean_max": b, "bary-sq_euclidean_mean": a * a, "bary-sq_euclidean_max": b * b})


# ---- centred distance or kernel matrices -----------------------------------------------------


def _dependence(x: np.ndarray, y: np.ndarray, kernel) -> dict[str, np.ndarray]:
    """Normalised product of two centred T x T tables, from row sums and cell products.

    Centring never materialises: biased and unbiased forms follow from the sums of A, B and AB.
    """
    b, n = x.shape
    keep = {k: np.zeros(b) for k in ("ab", "aa", "bb")}
    ra, rb = np.zeros((b, n)), np.zeros((b, n))
    fx, fy = kernel(x), kernel(y)
    for rows in row_blocks(b, n):
        a, c = fx(rows), fy(rows)
        on_diag = np.arange(rows.start, rows.stop)
        a[:, on_diag - rows.start, on_diag] = 0.0
        c[:, on_diag - rows.start, on_diag] = 0.0
        keep["ab"] += (a * c).sum(axis=(1, 2))
        keep["aa"] += (a * a).sum(axis=(1, 2))
        keep["bb"] += (c * c).sum(axis=(1, 2))
        ra[:, rows], rb[:, rows] = a.sum(axis=2), c.sum(axis=2)

    def pick(cell, u, v, diag, biased):
        if biased:  # the diagonal counts: it is 0 for distances, 1 for kernels
            u, v, cell = u + diag, v + diag, cell + diag * n
            return cell - 2 / n * (u * v).sum(axis=1) + u.sum(axis=1) * v.sum(axis=1) / n**2
        return cell - 2 / (n - 2) * (u * v).sum(axis=1) + u.sum(axis=1) * v.sum(axis=1) / ((n - 1) * (n - 2))

    out = {}
    for name, biased in (("unbiased", False), ("biased", True)):
        diag = kernel.diagonal
        ab, aa, bb = (pick(keep[k], u, v, diag, biased) for k, u, v in (("ab", ra, rb), ("aa", ra, ra), ("bb", rb, rb)))
        den = aa * bb
        out[name] = np.where((aa > 1e-12) & (bb > 1e-12), ab / np.sqrt(np.where(den > 0, den, np.nan)), np.nan)
    return out


def _distance_table(v: np.ndarray):
    return lambda rows: np.abs(v[:, rows, None] - v[:, None, :])


_distance_table.diagonal = 0.0


def _gaussian_table(v: np.ndarray):
    width = median_gaps(v)[:, None, None]
    return lambda rows: np.exp(-((v[:, rows, None] - v[:, None, :]) ** 2) / (2 * width**2))


_gaussian_table.diagonal = 1.0


TABLE_STEPS = 256  # steps of a series whose gaps are held in one table


def median_gaps(v: np.ndarray) -> np.ndarray:
    """:func:`median_gap` of each row: of short series by a table of all gaps, for some rows at a time."""
    b, n = v.shape
    if n > TABLE_STEPS:
        return np.array([median_gap(row) for row in v])
    i, j = np.triu_indices(n, 1)
    step = max(1, CELLS // len(i))
    return np.concatenate([np.median(np.abs(v[at : at + step, i] - v[at : at + step, j]), axis=1) for at in range(0, b, step)])


def median_gap(v: np.ndarray) -> float:
    """Median distance of all point pairs, by bisection on sorted values: no T x T table."""
    s = np.sort(v)
    n = len(s)
    m = n * (n - 1) // 2
    own = np.arange(n) + 1

    def kth(k: int) -> float:
        low, high = 0.0, s[-1] - s[0]
        if (np.searchsorted(s, s, "right") - own).sum() >= k:
            return 0.0
        for _ in range(64):
            mid = (low + high) / 2
            if (np.searchsorted(s, s + mid, "right") - own).sum() >= k:
                high = mid
            else:
                low = mid
        return high

    return kth(m // 2 + 1) if m % 2 else (kth(m // 2) + kth(m // 2 + 1)) / 2


def distance_correlation(x, y):
    return _dependence(x, y, _distance_table)


def kernel_dependence(x, y):
    return _dependence(x, y, _gaussian_table)


def spi_dcorr(panel: DataFrame) -> DataFrame:
    m = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], distance_correlation, ["unbiased", "biased"])
    return melt_stats(m, {"dcorr": F.col("unbiased"), "dcorr_biased": F.col("biased")})


def spi_hsic(panel: DataFrame) -> DataFrame:
    m = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], kernel_dependence, ["unbiased", "biased"])
    return melt_stats(m, {"hsic": F.col("unbiased"), "hsic_biased": F.col("biased")})


def lagged_distance_correlation(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = x.shape[1]
    total, out = np.zeros(len(x)), {}
    for lag in range(11):
        if n - lag > 3:
            a, b = (x, y) if lag == 0 else (x[:, :-lag], y[:, lag:])
            total = total + (n - lag) / n * np.nan_to_num(distance_correlation(a, b)["unbiased"])
        if lag in (1, 10):
            out[f"m{lag}"] = total.copy()
    return out


def spi_dcorrx(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel), PAIR, ["x", "y"], lagged_distance_correlation, ["m1", "m10"])
    return melt_stats(m, {"dcorrx_maxlag-1": F.col("m1"), "dcorrx_maxlag-10": F.col("m10")})


# ---- elastic alignments ----------------------------------------------------------------------

CONSTRAINTS = {"": "none", "_constraint-itakura": "itakura", "_constraint-sakoe-chiba": "sakoe"}


def _allowed(i: np.ndarray, j: np.ndarray, n: int, constraint: str) -> np.ndarray:
    """Cells a path may visit: all, a band of radius 1, or a parallelogram of slope 2."""
    if constraint == "sakoe":
        return np.abs(i - j) <= 1
    if constraint == "itakura":
        last = n - 1
        low = np.maximum(i / 2, 2 * i - last)
        high = np.minimum(2 * i, last - (last - i) / 2)
        return (j >= low) & (j <= high)
    return np.ones(len(i), dtype=bool)


def _diagonals(x: np.ndarray, y: np.ndarray, constraint: str, step, edge: float, first: float) -> np.ndarray:
    """Dynamic programme over anti-diagonals: three rows of state, whole batches at a time.

    ``step(up, left, corner, x_i, y_j, allowed)`` gives the cells of one anti-diagonal; ``edge``
    is the value outside the table and ``first`` the one before its first cell.
    """
    b, n = x.shape
    before = np.full((b, n + 1), edge)  # index i + 1 holds cell (i, d - i)
    last = np.full((b, n + 1), edge)
    before[:, 0] = first
    for d in range(2 * n - 1):
        i = np.arange(max(0, d - n + 1), min(d, n - 1) + 1)
        j = d - i
        now = np.full((b, n + 1), edge)
        now[:, i + 1] = step(last[:, i], last[:, i + 1], before[:, i], x[:, i], y[:, j], _allowed(i, j, n, constraint))
        before, last = last, now
        before = before.copy()
        if d == 0:
            before[:, 0] = edge
    return last[:, n]


def _dtw_step(up, left, corner, xi, yj, ok):
    best = np.minimum(np.minimum(up, left), corner)
    return np.where(ok, (xi - yj) ** 2 + best, np.inf)


def _softdtw_step(up, left, corner, xi, yj, ok):
    low = np.minimum(np.minimum(up, left), corner)
    base = np.where(np.isfinite(low), low, 0.0)
    soft = base - np.log(np.exp(base - up) + np.exp(base - left) + np.exp(base - corner))
    return np.where(ok & np.isfinite(low), (xi - yj) ** 2 + soft, np.inf)


def _lcss_step(up, left, corner, xi, yj, ok):
    return np.where(ok & (np.abs(xi - yj) <= 1.0), corner + 1, np.maximum(up, left))


def _elastic(panel: DataFrame, prefix: str, run) -> DataFrame:
    def fn(x, y):
        return {f"c{k}": run(x, y, c) for k, c in enumerate(CONSTRAINTS.values())}

    cols = [f"c{k}" for k in range(len(CONSTRAINTS))]
    m = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], fn, cols, power=1)
    return melt_stats(m, {prefix + tag: F.col(c) for tag, c in zip(CONSTRAINTS, cols)})


def dtw(x, y, constraint="none"):
    return np.sqrt(_diagonals(x, y, constraint, _dtw_step, np.inf, 0.0))


def soft_dtw(x, y, constraint="none"):
    return _diagonals(x, y, constraint, _softdtw_step, np.inf, 0.0)


def lcss(x, y, constraint="none"):
    return _diagonals(x, y, constraint, _lcss_step, 0.0, 0.0) / x.shape[1]


def spi_dtw(panel: DataFrame) -> DataFrame:
    return _elastic(panel, "dtw", dtw)


def spi_softdtw(panel: DataFrame) -> DataFrame:
    return _elastic(panel, "softdtw", soft_dtw)


def spi_lcss(panel: DataFrame) -> DataFrame:
    return _elastic(panel, "lcss", lcss)
