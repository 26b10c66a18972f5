"""Sparse inverse covariances of the channels of a sample.

Spark sums the moments of every two channels by fold of consecutive steps; a task then holds the channel-by-channel matrices of one sample, as for precision
matrices. Moments of training rows are those of all folds less the one left out, so the penalty is chosen without reading the series again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, group_starts, local_codes, map_whole
from pairspan.operators.pairs import PAIR, melt_stats, pair_self_join

PENALTY = 0.01
FOLDS = 5
PENALTIES = 16  # tried by cross-validation, from the largest covariance down to a hundredth of it


def fold_moments(panel: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``sample_id, node_from, node_to, fold, n, sx, sy, sxy`` of channel pairs, a channel with itself included; folds are equal spans of the sample's steps."""
    span = panel.groupBy("sample_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    pts = pair_self_join(panel, include_self=True).where("x IS NOT NULL AND y IS NOT NULL").join(span, "sample_id")
    fold = F.floor((F.col("t") - F.col("t0")) * folds / (F.col("t1") - F.col("t0") + 1)).cast("int")
    x, y = F.col("x"), F.col("y")
    return pts.groupBy(*PAIR, fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"))


def graphical_lasso(s: np.ndarray, penalty: np.ndarray, tol: float = 1e-7, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Covariances and precisions (b, p, p) that minimise ``tr(s P) - log det P + penalty * sum of |P_ij|, i <> j`` for b problems at once.

    Column after column, a penalised regression on the other channels gives the column of the covariance; rounds of a problem go on until none of its cells moves.
    """
    b, p, _ = s.shape
    cov = np.ascontiguousarray(np.moveaxis(s, 0, 2))  # problems side by side
    w, beta, live, penalty = cov.copy(), np.zeros((p, p, b)), np.arange(b), np.asarray(penalty)
    whole_w, whole_beta = np.empty((p, p, b)), np.empty((p, p, b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.flatnonzero(np.arange(p) != j)
            w11, own = w[np.ix_(rest, rest)], beta[j, rest]
            _regress(w11, cov[rest, j], own, penalty, tol / 10)
            beta[j, rest] = own
            w[rest, j] = w[j, rest] = (w11 * own).sum(axis=1)
        done = np.abs(w - before).max(axis=(0, 1)) < tol
        if done.any():
            whole_w[:, :, live[done]], whole_beta[:, :, live[done]] = w[:, :, done], beta[:, :, done]
            w, beta, cov, live, penalty = w[:, :, ~done], beta[:, :, ~done], cov[:, :, ~done], live[~done], penalty[~done]
        if not len(live):
            break
    else:
        raise ArithmeticError("no convergence of a sparse covariance")
    w, beta = np.ascontiguousarray(np.moveaxis(whole_w, 2, 0)), np.moveaxis(whole_beta, 2, 0)
    precision = np.zeros_like(w)
    for j in range(p):
        rest = np.flatnonzero(np.arange(p) != j)
        precision[:, j, j] = 1 / (w[:, j, j] - np.einsum("bi,bi->b", w[:, rest, j], beta[:, j, rest]))
        precision[:, j, rest] = -beta[:, j, rest] * precision[:, j, j][:, None]
    return w, (precision + np.swapaxes(precision, 1, 2)) / 2


def _regress(w: np.ndarray, s: np.ndarray, beta: np.ndarray, penalty: np.ndarray, tol: float) -> None:
    """Coefficients ``beta`` (channel, problem) of the penalised regressions, in place: coordinate by coordinate, until a problem's do not move."""
    out, live = beta, None
    for _ in range(200):
        moved = np.zeros(beta.shape[1])
        for k in range(len(beta)):
            pull = s[k] - (w[k] * beta).sum(axis=0) + w[k, k] * beta[k]
            new = (pull - np.clip(pull, -penalty, penalty)) / w[k, k]
            np.maximum(moved, np.abs(new - beta[k]), out=moved)
            beta[k] = new
        on = ~(moved < tol)
        if on.all():
            continue
        if live is None:
            live = np.arange(len(on))
        else:
            out[:, live[~on]] = beta[:, ~on]
        if not on.any():
            return
        w, s, beta, penalty, live = w[:, :, on], s[:, on], beta[:, on], penalty[on], live[on]
    if live is not None:
        out[:, live] = beta


def covariance(n: np.ndarray, sx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Covariances about the mean; ``sx[i, j]`` is the sum of channel i over the steps that it has with j."""
    n = np.maximum(n, 1)
    return sxy / n - sx * np.swapaxes(sx, -1, -2) / n**2


def chosen_penalty(n: np.ndarray, sx: np.ndarray, sxy: np.ndarray, penalties: int = PENALTIES) -> float:
    """The penalty of the greatest mean log likelihood of the folds (first axis) left out; the larger one of ties."""
    return float(chosen_penalties(n[None], sx[None], sxy[None], penalties)[0])


def chosen_penalties(n: np.ndarray, sx: np.ndarray, sxy: np.ndarray, penalties: int = PENALTIES) -> np.ndarray:
    """The penalties of samples (first axis) with moments by fold (second)."""
    p = n.shape[-1]
    whole = covariance(n.sum(1), sx.sum(1), sxy.sum(1))
    top = np.abs(whole[:, ~np.eye(p, dtype=bool)]).max(axis=1, initial=0.0)
    tried = np.where(top > 0, top, 1.0)[:, None] * np.logspace(0, -2, penalties)
    train, test = covariance(n.sum(1, keepdims=True) - n, sx.sum(1, keepdims=True) - sx, sxy.sum(1, keepdims=True) - sxy), covariance(n, sx, sxy)

    def least(v: np.ndarray) -> np.ndarray:
        return np.einsum("sfii->sfi", v).min(axis=2)

    good = (least(n) > 1) & (least(train) > 1e-9) & (top > 0)[:, None]
    sample, fold = np.nonzero(good)
    gain = np.zeros((len(n), penalties, n.shape[1]))
    if len(sample):
        _, prec = graphical_lasso(np.repeat(train[sample, fold], penalties, axis=0), tried[sample].ravel())
        prec = prec.reshape(len(sample), penalties, p, p)
        gain[sample, :, fold] = np.linalg.slogdet(prec)[1] - np.einsum("kij,kaji->ka", test[sample, fold], prec)
    mean = gain.sum(axis=2) / np.maximum(good.sum(axis=1), 1)[:, None]
    best = tried[np.arange(len(n)), np.argmax(np.round(mean, 12), axis=1)]
    return np.where(top > 0, best, PENALTY)


NAMES = ("GraphicalLasso", "GraphicalLassoCV")


def spi_graphical_lasso(panel: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Covariance and precision under a fixed penalty and under one chosen by cross-validation; a channel without values has NULL in its pairs."""

    def solve(table: pa.Table) -> pa.Table:
        first = group_starts(table, ["sample_id"])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        names, there, (i, j) = local_codes(group, len(first), table["node_from"], table["node_to"])
        ids, all_names, size, fold = table["sample_id"].combine_chunks().take(pa.array(first)), pa.array(names, pa.string()), there.sum(axis=1), table["fold"].to_numpy()
        numbers = {k: table[k].to_numpy() for k in ("n", "sx", "sy", "sxy")}
        parts = []
        for p in np.unique(size[size > 1]):
            same = np.flatnonzero(size == p)
            step = max(1, int(4 * CELLS // (PENALTIES * FOLDS * p * p)))
            for at in range(0, len(same), step):
                own = same[at : at + step]
                row = np.flatnonzero(np.isin(group, own))
                g, f, a, b = np.searchsorted(own, group[row]), fold[row], i[row], j[row]
                n, sx, sxy = (np.zeros((len(own), FOLDS, p, p)) for _ in range(3))
                n[g, f, a, b] = n[g, f, b, a] = numbers["n"][row]
                sxy[g, f, a, b] = sxy[g, f, b, a] = numbers["sxy"][row]
                sx[g, f, a, b], sx[g, f, b, a] = numbers["sx"][row], numbers["sy"][row]
                s = covariance(n.sum(1), sx.sum(1), sxy.sum(1))
                x, y = np.triu_indices(p, 1)
                nodes = np.nonzero(there[own])[1].reshape(len(own), p)
                columns = {"sample_id": ids.take(pa.array(np.repeat(own, len(x)))), "node_from": all_names.take(pa.array(nodes[:, x].ravel())), "node_to": all_names.take(pa.array(nodes[:, y].ravel()))}
                solved = [graphical_lasso(s, chosen) for chosen in (np.full(len(own), penalty), chosen_penalties(n, sx, sxy))]
                for k, kind in enumerate(("cov", "prec")):
                    columns |= {f"{kind}_{name}": pa.array(v[k][:, x, y].ravel()) for name, v in zip(NAMES, solved, strict=True)}
                parts.append(pa.table(columns))
        return pa.concat_tables(parts) if parts else none

    kinds = [f"{kind}_{name}" for kind in ("cov", "prec") for name in NAMES]
    schema = "sample_id string, node_from string, node_to string, " + ", ".join(f"{k} double" for k in kinds)
    none = pa.table({k: pa.array([], pa.string()) for k in PAIR} | {k: pa.array([], pa.float64()) for k in kinds})
    solved = map_whole(fold_moments(panel), ["sample_id"], solve, schema)
    nodes = panel.select("sample_id", "node").distinct()
    every = nodes.withColumnRenamed("node", "node_from").join(nodes.withColumnRenamed("node", "node_to"), "sample_id").where("node_from < node_to")
    stats: dict[str, Column] = {}
    for k in kinds:
        kind, name = k.split("_")
        stats |= {k: F.col(k), f"{kind}-sq_{name}": F.col(k) * F.col(k)}
    return melt_stats(every.join(solved, PAIR, "left"), stats)
