"""Direction-seeking statistics: conditional spread, regression error, slopes, cross mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, lists_to_numpy, map_arrays, row_blocks
from pairspan.functions.numeric import ratio
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats, pair_arrays
from pairspan.operators.windows import join_group_stats

CDS_BINS = 13


def _cell_counts(arrays: DataFrame) -> DataFrame:
    """One row per pair and block: the cells of its histogram that hold points (bin of x times the bins, plus bin of y), and how many."""
    size = CDS_BINS**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            longest = max(1, pc.max(pc.list_value_length(rb.column(3))).as_py() or 1)
            step = max(1, 4 * CELLS // longest)
            for at in range(0, rb.num_rows, step):
                part = rb.slice(at, step)
                x, y = (lists_to_numpy(part.column(k)) for k in (3, 4))
                row, x, y = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x), np.concatenate(y)
                good = ~(np.isnan(x) | np.isnan(y))
                code, n = np.unique(row[good] * size + (x[good] * CDS_BINS + y[good]).astype(np.int64), return_counts=True)
                ends = pa.array(np.searchsorted(code, np.arange(len(part) + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (code % size, n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=[*PAIR, "cells", "n"])

    return arrays.select(*PAIR, "x", "y").mapInArrow(run, "sample_id string, node_from string, node_to string, cells array<long>, n array<long>").where("size(cells) > 0")


def conditional_spread(h: np.ndarray) -> np.ndarray:
    """Of histograms (pair, bin of x, bin of y): the spread of the shares of y over the bins of x that hold points, averaged over all bins of y."""
    of_x = h.sum(axis=2)
    p = h / np.where(of_x > 0, of_x, 1)[:, :, None]
    k = (of_x > 0).sum(axis=1)[:, None]
    mean = p.sum(axis=1) / k
    return np.sqrt(np.maximum(0.0, (p * p).sum(axis=1) / k - mean * mean)).sum(axis=1) / CDS_BINS


def spi_cds(panel: DataFrame) -> DataFrame:
    """Spread, across bins of x, of the conditional histogram of y."""
    v = F.col("signal")
    df = join_group_stats(panel, ["sample_id", "node"], _low=F.min(v), _high=F.max(v))
    bin_no = F.floor(ratio(v - F.col("_low"), (F.col("_high") - F.col("_low")) / CDS_BINS))
    df = df.withColumn("bin", F.least(bin_no, F.lit(CDS_BINS - 1)).cast("double"))
    counts = _cell_counts(pair_arrays(df, directed=True, value="bin", block=4096))
    # at most 13 x 13 cells per pair and block from here on
    whole = counts.groupBy(*PAIR).agg(F.flatten(F.collect_list("cells")).alias("cells"), F.flatten(F.collect_list("n")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row = np.repeat(np.arange(rb.num_rows), pc.list_value_length(rb.column(3)).to_numpy())
            cell, n = (rb.column(k).flatten().to_numpy() for k in (3, 4))
            h = np.bincount(row * CDS_BINS**2 + cell, n, rb.num_rows * CDS_BINS**2).reshape(-1, CDS_BINS, CDS_BINS)
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(conditional_spread(h))], names=[*PAIR, "v"])

    out = whole.mapInArrow(run, "sample_id string, node_from string, node_to string, v double")
    return melt_stats(out, {"cds": F.col("v")})


def spi_igci(panel: DataFrame) -> DataFrame:
    """Mean log slope of y over x minus that of x over y, on min-max scaled series."""
    scale = "transform({v}, a -> try_divide(a - array_min({v}), array_max({v}) - array_min({v})))"
    a = pair_arrays(panel, directed=True, value="signal")
    a = a.select(*PAIR, F.expr(scale.format(v="x")).alias("x"), F.expr(scale.format(v="y")).alias("y"))
    half = (
        "filter(transform(sequence(1, size(s) - 1), i -> "
        "CASE WHEN s[i].p <> s[i - 1].p AND s[i].q <> s[i - 1].q THEN ln(abs(s[i].q - s[i - 1].q) / abs(s[i].p - s[i - 1].p)) END), v -> v IS NOT NULL)"
    )
    a = a.withColumn("s", F.expr("array_sort(zip_with(x, y, (u, w) -> named_struct('p', u, 'q', w)))")).withColumn("f", F.expr(half))
    a = a.withColumn("s", F.expr("array_sort(zip_with(y, x, (u, w) -> named_struct('p', u, 'q', w)))")).withColumn("b", F.expr(half))
    mean = "try_divide(aggregate({c}, 0D, (s, v) -> s + v), cast(size({c}) as double))"
    return melt_stats(a, {"igci": F.expr(mean.format(c="f")) - F.expr(mean.format(c="b"))})


def cubic_error(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Mean squared error of the least-squares cubic of y on x, both scaled to [0, 1]."""
    x, y = ((v - v.min(axis=1, keepdims=True)) / np.ptp(v, axis=1)[:, None] for v in (x, y))
    basis = np.stack([np.ones_like(x), x, x**2, x**3], axis=2)
    coef = np.linalg.pinv(basis) @ y[:, :, None]
    return {"v": ((y - (basis @ coef)[:, :, 0]) ** 2).mean(axis=1)}


def spi_reci(panel: DataFrame) -> DataFrame:
    m = map_arrays(pair_arrays(panel, directed=True), PAIR, ["x", "y"], cubic_error, ["v"], power=1)
    return melt_stats(m, {"reci": F.col("v")})


def _nearest(square: np.ndarray, at: np.ndarray, sizes: list[int], count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distances at 9 digits and places of the nearest points of each row among the first ones, for several numbers of those; of equal ones the first.

    A distance and its place are one whole number, so that sorting numbers is enough.
    """
    m = square.shape[2]
    scaled = np.rint(np.sqrt(square) * 1e9)
    bits = max(1, int(m - 1).bit_length())
    if not scaled.max(initial=0.0) < 2.0 ** (62 - bits):  # too large for that
        dist = scaled / 1e9
        dist[:, np.arange(len(at)), at] = np.inf
        order = [np.argsort(dist[:, :, :size], axis=2, kind="stable")[:, :, :count] for size in sizes]
        return [(np.take_along_axis(dist, o, axis=2), o) for o in order]
    key = (scaled.astype(np.int64) << bits) | np.arange(m)
    key[:, np.arange(len(at)), at] = np.iinfo(np.int64).max
    out = []
    for size in sizes:
        first = np.sort(key[:, :, :size], axis=2)[:, :, :count]
        out.append(((first >> bits) / 1e9, first & ((1 << bits) - 1)))
    return out


def _skills(x: np.ndarray, y: np.ndarray, max_dim: int = 10) -> dict[int, np.ndarray]:
    """Skill of predicting x from the delay vectors of y: per embedding, batch x library sizes.

    The squared distance of two delay vectors grows by one term per dimension, so all embeddings
    share one pass over blocks of rows; a smaller library is the head of a larger one. A series stands in the pairs
    with all other channels: its neighbours are searched once for those of a batch.
    """
    b, n = x.shape
    own, of_y = np.unique(y, axis=0, return_inverse=True)
    sizes = {d: [s for s in sorted({(n - d + 1) * q // 4 for q in (1, 2, 3, 4)}) if s >= d + 2] for d in range(1, max_dim + 1)}
    pred = {d: np.empty((len(s), b, n - d + 1)) for d, s in sizes.items() if s}
    for rows in row_blocks(b, n):
        at = np.arange(rows.start, rows.stop)
        square = np.zeros((len(own), len(at), n))
        for d in range(1, max_dim + 1):
            m = n - d + 1
            at = at[at < m]
            square = square[:, : len(at), :m] + (own[:, at + d - 1, None] - own[:, None, d - 1 : n]) ** 2
            if not len(at) or d not in pred:
                continue
            first_of = (np.arange(b) * n + d - 1).reshape(-1, 1, 1)
            for k, (near, order) in enumerate(_nearest(square, at, sizes[d], d + 1)):
                first = near[:, :, :1]
                w = np.where(first > 0, np.exp(-near / np.where(first > 0, first, 1.0)), (near == 0) * 1.0)
                hit = x.ravel()[order[of_y] + first_of]
                pred[d][k][:, at] = np.einsum("brk,brk->br", w[of_y], hit) / w.sum(axis=2)[of_y]
    out = {}
    for d in range(1, max_dim + 1):
        got = [_row_corr(p, x[:, d - 1 :]) for p in pred.get(d, [])]
        out[d] = np.stack(got, axis=1) if got else np.full((b, 1), np.nan)
    return out


def _row_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    den = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(den > 1e-12, (a * b).sum(axis=1) / np.where(den > 0, den, 1.0), np.nan)


def _over(skill: np.ndarray, how) -> np.ndarray:
    """Mean or maximum over the library sizes that have a skill."""
    out = np.full(len(skill), np.nan)
    some = np.isfinite(skill).any(axis=1)
    out[some] = how(skill[some], axis=1)
    return out


def cross_mapping(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Cross-map skill for embedding 1, 10 and the best of 1..10, in both directions of the pair."""
    both = _skills(np.concatenate([x, y]), np.concatenate([y, x]))
    skills = {"f": {d: v[: len(x)] for d, v in both.items()}, "b": {d: v[len(x) :] for d, v in both.items()}}
    out = {}
    for way, back in (("f", "b"), ("b", "f")):
        mine, other = skills[way], skills[back]
        full = np.stack([np.nan_to_num(mine[e][:, -1], nan=-2.0) for e in range(1, 11)], axis=1)
        best = full.argmax(axis=1)
        for tag in ("1", "10", "None"):
            stats = [(_over(mine[e], np.nanmean), _over(mine[e], np.nanmax), _over(mine[e], np.nanmean) - _over(other[e], np.nanmean)) for e in (range(1, 11) if tag == "None" else [int(tag)])]
            pick = best if tag == "None" else np.zeros(len(x), dtype=int)
            for k, name in enumerate(("mean", "max", "diff")):
                out[f"{way}_E-{tag}_{name}"] = np.stack([s[k] for s in stats], axis=1)[np.arange(len(x)), pick]
    return out


def spi_ccm(panel: DataFrame) -> DataFrame:
    """Each pair is visited once; its two directions share the neighbour searches."""
    names = [f"E-{e}_{s}" for e in ("1", "10", "None") for s in ("mean", "max", "diff")]
    m = map_arrays(grid_arrays(panel), PAIR, ["x", "y"], cross_mapping, [f"{w}_{c}" for w in "fb" for c in names])
    forward = [F.struct(F.lit(f"ccm_{c}").alias("spi"), "node_from", "node_to", F.col(f"`f_{c}`").alias("value")) for c in names]
    backward = [
        F.struct(F.lit(f"ccm_{c}").alias("spi"), F.col("node_to").alias("node_from"), F.col("node_from").alias("node_to"), F.col(f"`b_{c}`").alias("value"))
        for c in names
    ]
    return m.select("sample_id", F.inline(F.array(*forward, *backward))).select("spi", *PAIR, "value")
