"""Robust covariances of the channels of a sample: the half of the steps whose covariance has the least determinant, then reweighted.

Steps with a value in every channel are packed in blocks. A sample with a single block is settled where the block is, all its starts and those of other samples side by side. For samples
of several blocks, a concentration round sends the current means and precisions of all starts to the blocks, finds the distance
of the h-th nearest step and sums the moments of the steps up to it; rounds go on until no determinant falls. Vectors stay with their blocks: a task that looks for the h-th nearest holds one number for
each step of a sample, as whole-series statistics do, and channel-by-channel matrices go to one task for each sample and start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS
from pairspan.operators.pairs import PAIR, melt_stats
from pairspan.operators.shared import shared
from pairspan.session import cut_lineage

STARTS = 20
BLOCK = 4096
ROUNDS = 200
SINGULAR = 1e-12  # smallest eigenvalue over the largest

_STATE = "sample_id string, start int, n long, p int, mean array<double>, prec array<double>, logdet double, before double"
_CUT = "sample_id string, start int, d double, t long"
_MOMENTS = "sample_id string, start int, n_all long, before double, k long, s array<double>, ss array<double>"


def chi2_quantile(q: float, p: int) -> float:
    """Quantile of the chi-square distribution with p degrees of freedom, by bisection of the series of its distribution function."""

    def below(x: float) -> float:
        a, z = p / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0

    lo, hi = 0.0, 2.0 * p + 10
    while below(hi) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return (lo + hi) / 2


def step_blocks(panel: DataFrame, block: int = BLOCK, value: str = "z") -> DataFrame:
    """``sample_id, blk, nodes, ts, vs``: vectors (one after another in ``vs``) of the steps where every channel of the sample that has values at all has one."""
    live = panel.where(F.col(value).isNotNull())
    width = live.select("sample_id", "node").distinct().groupBy("sample_id").agg(F.count(F.lit(1)).alias("p"))
    steps = live.groupBy("sample_id", "t").agg(F.array_sort(F.collect_list(F.struct("node", F.col(value).cast("double").alias("v")))).alias("c"))
    whole = steps.join(width, "sample_id").where(F.size("c") == F.col("p"))
    blk = F.floor(F.col("t") / block).alias("blk")
    packed = whole.groupBy("sample_id", blk).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), "c"))).alias("rows"))
    vectors = F.flatten(F.transform("rows", lambda r: F.transform(r["c"], lambda c: c["v"])))
    return packed.select("sample_id", "blk", F.col("rows.c")[0]["node"].alias("nodes"), F.col("rows.t").alias("ts"), vectors.alias("vs"))


def _rows(col: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    return np.split(col.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1]) if len(col) else []


def distances(x: np.ndarray, mean: np.ndarray, prec: np.ndarray) -> np.ndarray:
    """Distances of steps (..., step, channel) from means (..., channel)."""
    y = x - mean[..., None, :]
    return np.einsum("...ij,...ij->...i", y @ prec.reshape(*mean.shape, mean.shape[-1]), y)


def solved(k: np.ndarray, s: np.ndarray, ss: np.ndarray, ridge: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, precisions and log determinants from the sums of each state; minus infinity where the covariance is singular."""
    p = s.shape[1]
    mean = s / k[:, None]
    cov = ss.reshape(-1, p, p) / k[:, None, None] - mean[:, :, None] * mean[:, None, :]
    values, vectors = np.linalg.eigh((cov + np.swapaxes(cov, 1, 2)) / 2 + np.reshape(ridge, (-1, 1, 1)) * np.eye(p))
    good = values[:, 0] > SINGULAR * values[:, -1]
    values = np.where(good[:, None], values, 1.0)
    prec = (vectors / values[:, None, :]) @ np.swapaxes(vectors, 1, 2)
    return mean, np.where(good[:, None, None], prec, np.nan), np.where(good, np.log(values).sum(axis=1), -np.inf)


def begun(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of a few drawn steps each, with a little added to the diagonal so that they exist."""
    spread = np.maximum(drawn.var(axis=1).sum(axis=1) / drawn.shape[2], 1e-12)
    return solved(np.full(len(drawn), drawn.shape[1]), drawn.sum(axis=1), np.swapaxes(drawn, 1, 2) @ drawn, 1e-3 * spread)


def nearest_half(d: np.ndarray, t: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and step of the h-th nearest of each state; of equal distances the earlier step first."""
    place = np.lexsort((t, d), axis=1)[:, (d.shape[1] + p + 1) // 2 - 1, None]
    return np.take_along_axis(d, place, axis=1), np.take_along_axis(t, place, axis=1)


def reweighting(d: np.ndarray, p: int) -> np.ndarray:
    """The largest distance that a normal sample of the same median has in 97.5 of 100 cases."""
    return np.median(d, axis=1) / chi2_quantile(0.5, p) * chi2_quantile(0.975, p)


def refitted(x: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States from the steps of each that are kept."""
    own = x * kept[:, :, None]
    return solved(np.maximum(kept.sum(axis=1), 1), own.sum(axis=1), np.swapaxes(own, 1, 2) @ own)


def settled(x: np.ndarray, t: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Precision and log determinant of the reweighted estimate of whole samples ``x`` (sample, step, channel); minus infinity where there is none.

    A start rests on its own, whatever it is computed with.
    """
    many, n, p = x.shape
    first = [np.argsort(_order(t, start) >> np.uint64(1), axis=1, kind="stable")[:, : p + 1, None] for start in range(starts)]
    drawn = np.stack([np.take_along_axis(x, f, axis=1) for f in first], axis=1)
    mean, prec, _ = begun(drawn.reshape(-1, p + 1, p))
    logdet, live, room = np.full(many * starts, np.inf), np.arange(many * starts), max(1, 4 * CELLS // (n * p))
    for _ in range(ROUNDS):
        on = []
        for at in range(0, len(live), room):
            own = live[at : at + room]
            xs, ts, before = x[own // starts], t[own // starts], logdet[own]
            d = distances(xs, mean[own], prec[own])
            last, step = nearest_half(d, ts, p)
            mean[own], prec[own], logdet[own] = refitted(xs, (d < last) | ((d == last) & (ts <= step)))
            on.append(own[(logdet[own] > -np.inf) & ~(np.abs(before - logdet[own]) < 1e-9)])
        live = np.concatenate(on)
        if not len(live):
            break
    else:
        raise ArithmeticError("concentration steps did not come to rest")
    best = np.arange(many) * starts + logdet.reshape(many, starts).argmin(axis=1)
    out, found = np.full((many, p, p), np.nan), np.full(many, -np.inf)
    some = np.flatnonzero(logdet[best] > -np.inf)
    if len(some):
        d = distances(x[some], mean[best[some]], prec[best[some]])
        _, out[some], found[some] = refitted(x[some], d < reweighting(d, p)[:, None])
    return out, found


def _order(t: np.ndarray, start: int) -> np.ndarray:
    """A random order of steps for each start, the same in any run."""
    h = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start * 0xC2B2AE3D27D4EB4F % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def first_states(blocks: DataFrame, starts: int) -> DataFrame:
    """Means and precisions of p + 1 random steps for each start, with a little added to the diagonal so that they exist."""
    size = blocks.groupBy("sample_id").agg(F.sum(F.size("ts")).alias("n"))

    def draw(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("sample_id", "start", "h", "v")}
            for sample, nodes, ts, vs in zip(b["sample_id"].to_pylist(), b["nodes"].to_pylist(), _rows(b["ts"]), _rows(b["vs"]), strict=True):
                x = vs.reshape(len(ts), -1)
                for start in range(starts):
                    h = _order(ts, start)
                    for i in np.argsort(h, kind="stable")[: len(nodes) + 1]:
                        for k, v in zip(out, (sample, start, int(h[i] >> np.uint64(1)), x[i].tolist()), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("sample_id", pa.string()), ("start", pa.int32()), ("h", pa.int64()), ("v", pa.list_(pa.float64()))]))

    def begin(table: pa.Table) -> pa.Table:
        x = np.array(table["v"].to_pylist())[np.argsort(table["h"].to_numpy(), kind="stable")][: len(table["v"][0]) + 1]
        mean, prec, _ = begun(x[None])
        return _state_row(table, table["n"][0].as_py(), mean[0], prec[0], np.inf, np.inf)

    drawn = blocks.mapInArrow(draw, "sample_id string, start int, h long, v array<double>").join(size, "sample_id")
    return drawn.where(F.col("n") > F.size("v") + 1).groupBy("sample_id", "start").applyInArrow(begin, _STATE)


def _state_row(table: pa.Table, n: int, mean: np.ndarray, prec: np.ndarray, logdet: float, before: float) -> pa.Table:
    return pa.table({
        "sample_id": pa.array([table["sample_id"][0].as_py()], pa.string()), "start": pa.array([table["start"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()),
        "p": pa.array([len(mean)], pa.int32()), "mean": pa.array([mean], pa.list_(pa.float64())), "prec": pa.array([prec.ravel()], pa.list_(pa.float64())),
        "logdet": pa.array([logdet], pa.float64()), "before": pa.array([before], pa.float64()),
    })


def _far(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distances of all steps from every state, a row for each block."""

    def run(batches):
        for b in batches:
            d = [distances(v.reshape(len(t), -1), m, c) for v, t, m, c in zip(_rows(b["vs"]), _rows(b["ts"]), _rows(b["mean"]), _rows(b["prec"]), strict=True)]
            yield pa.RecordBatch.from_arrays([b["sample_id"], b["start"], b["n"], b["p"], b["ts"], pa.array(d, pa.list_(pa.float64()))], names=["sample_id", "start", "n", "p", "ts", "d"])

    return blocks.join(states, "sample_id").mapInArrow(run, "sample_id string, start int, n long, p int, ts array<long>, d array<double>")


def _cuts(far: DataFrame, reweight: bool) -> DataFrame:
    """The last step to keep of each state: the h-th nearest, or, to reweight, the largest distance that a normal sample of the same median has in 97.5 of 100 cases."""

    def cut(table: pa.Table) -> pa.Table:
        d, t = np.concatenate(_rows(table["d"])), np.concatenate(_rows(table["ts"]))
        p = table["p"][0].as_py()
        if reweight:
            last, step = reweighting(d[None], p), np.array([-1])
        else:
            last, step = (v[0] for v in nearest_half(d[None], t[None], p))
        return pa.table({"sample_id": table["sample_id"][:1], "start": table["start"][:1], "d": pa.array(last), "t": pa.array(step, pa.int64())})

    return far.groupBy("sample_id", "start").applyInArrow(cut, _CUT)


def _kept(states: DataFrame, blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Sums over the steps up to each state's cut, a row for each block."""

    def run(batches):
        for b in batches:
            k, s, ss = [], [], []
            for v, t, m, c, d, last in zip(_rows(b["vs"]), _rows(b["ts"]), _rows(b["mean"]), _rows(b["prec"]), b["d"].to_pylist(), b["t"].to_pylist(), strict=True):
                x = v.reshape(len(t), -1)
                far = distances(x, m, c)
                x = x[(far < d) | ((far == d) & (t <= last))]
                k.append(len(x))
                s.append(x.sum(0))
                ss.append((x.T @ x).ravel())
            names = ["sample_id", "start", "n_all", "before", "k", "s", "ss"]
            yield pa.RecordBatch.from_arrays([b["sample_id"], b["start"], b["n"], b["logdet"], pa.array(k, pa.int64()), pa.array(s, pa.list_(pa.float64())), pa.array(ss, pa.list_(pa.float64()))], names=names)

    return blocks.join(states.join(cuts, ["sample_id", "start"]), "sample_id").mapInArrow(run, _MOMENTS)


def _refit(moments: DataFrame) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        k = int(table["k"].to_numpy().sum())
        s, ss = np.sum(_rows(table["s"]), axis=0), np.sum(_rows(table["ss"]), axis=0)
        before = table["before"][0].as_py()
        mean, prec, logdet = solved(np.array([max(k, 1)]), s[None], ss[None])
        return _state_row(table, table["n_all"][0].as_py(), mean[0], prec[0], float(logdet[0]), before)

    return moments.groupBy("sample_id", "start").applyInArrow(one, _STATE)


def least_determinant(blocks: DataFrame, starts: int = STARTS) -> DataFrame:
    """The state of the least determinant of each sample, after all starts have come to rest. A singular one is minus infinity."""
    states = cut_lineage(first_states(blocks, starts))
    rest: list[DataFrame] = []
    for _ in range(ROUNDS):
        states = cut_lineage(_refit(_kept(states, blocks, _cuts(_far(states, blocks), False))))
        still = F.isnan("logdet") | (F.col("logdet") == float("-inf")) | (F.abs(F.col("before") - F.col("logdet")) < 1e-9)
        rest.append(states.where(still))
        states = states.where(~still)
        if states.isEmpty():
            break
    else:
        raise ArithmeticError("concentration steps did not come to rest")
    found = rest[0]
    for part in rest[1:]:
        found = found.unionByName(part)
    best = found.groupBy("sample_id").agg(F.min(F.struct("logdet", "start")).alias("best"))
    return cut_lineage(found.join(best, "sample_id").where((F.col("start") == F.col("best.start"))).drop("best"))


def settled_rows(blocks: DataFrame, starts: int) -> DataFrame:
    """``sample_id, nodes, prec`` of samples that are one block each, many of the same size in a call."""

    def run(batches):
        for b in batches:
            ts, vs = _rows(b["ts"]), _rows(b["vs"])
            sizes = np.array([(len(t), len(v) // len(t)) for t, v in zip(ts, vs, strict=True)]).reshape(-1, 2)
            for n, p in np.unique(sizes[sizes[:, 0] > sizes[:, 1] + 1], axis=0):
                same = np.flatnonzero((sizes == (n, p)).all(axis=1))
                room = max(1, 16 * CELLS // (starts * n * p))
                for at in range(0, len(same), room):
                    own = same[at : at + room]
                    prec, logdet = settled(np.stack([vs[i].reshape(n, p) for i in own]), np.stack([ts[i] for i in own]), starts)
                    good = np.flatnonzero(logdet > -np.inf)
                    cells = pa.array(list(prec[good].reshape(len(good), p * p)), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b["sample_id"].take(pa.array(own[good])), b["nodes"].take(pa.array(own[good])), cells], names=["sample_id", "nodes", "prec"])

    return blocks.select("sample_id", "nodes", "ts", "vs").mapInArrow(run, "sample_id string, nodes array<string>, prec array<double>")


@shared(written=True)
def robust_covariances(panel: DataFrame, starts: int = STARTS, block: int = BLOCK) -> DataFrame:
    """``sample_id, nodes, prec`` (row by row) of the reweighted estimate; samples whose nearest half is singular, or with too few steps, are left out."""
    every = cut_lineage(step_blocks(panel, block))
    single = every.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    near, blocks = settled_rows(every.join(single, "sample_id", "left_semi"), starts), every.join(single, "sample_id", "left_anti")
    if blocks.isEmpty():
        return near
    best = least_determinant(blocks, starts).where(F.col("logdet") > float("-inf"))
    final = _refit(_kept(best, blocks, _cuts(_far(best, blocks), True)))
    nodes = blocks.groupBy("sample_id").agg(F.min("nodes").alias("nodes"))
    return near.unionByName(final.where(F.col("logdet") > float("-inf")).join(nodes, "sample_id").select("sample_id", "nodes", "prec"))


NAMES = ("MinCovDet", "EllipticEnvelope")  # the envelope is drawn around the same estimate


def spi_robust(panel: DataFrame, starts: int = STARTS, block: int = BLOCK) -> DataFrame:
    """Robust covariance and precision of every pair of channels, plain and squared; NULL where there is no estimate."""

    def pairs(batches):
        for b in batches:
            for sample, nodes, prec in zip(b["sample_id"].to_pylist(), b["nodes"].to_pylist(), _rows(b["prec"]), strict=True):
                m = prec.reshape(len(nodes), -1)
                x, y = np.triu_indices(len(nodes), 1)
                names = pa.array(nodes, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sample] * len(x), pa.string()), names.take(pa.array(x)), names.take(pa.array(y)), pa.array(np.linalg.inv(m)[x, y]), pa.array(m[x, y])], names=[*PAIR, "cov", "prec"]
                )

    values = robust_covariances(panel, int(starts), int(block)).mapInArrow(pairs, "sample_id string, node_from string, node_to string, cov double, prec double")
    nodes = panel.select("sample_id", "node").distinct()
    every = nodes.withColumnRenamed("node", "node_from").join(nodes.withColumnRenamed("node", "node_to"), "sample_id").where("node_from < node_to")
    stats: dict[str, Column] = {}
    for kind in ("cov", "prec"):
        for name in NAMES:
            stats |= {f"{kind}_{name}": F.col(kind), f"{kind}-sq_{name}": F.col(kind) * F.col(kind)}
    return melt_stats(every.join(values, PAIR, "left"), stats)
