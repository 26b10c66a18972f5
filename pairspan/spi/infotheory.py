"""Entropies, mutual information and transfer entropy.

Gaussian forms with few variables come straight from Spark moments. The others are sums and
differences of entropies of delay-embedded variables, written as a list of terms per statistic.
Statistics that look back in time read one place per step: a pair with a missing step is NULL in those that need
whole histories, and the gaussian ones leave out the points that miss a partner.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspan.functions import neighbours as nb
from pairspan.functions.batches import map_arrays
from pairspan.functions.numeric import log_positive, pearson, ratio
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats, pair_arrays, series_grid
from pairspan.spi.basic import pair_moments

Var = tuple[str, int]  # series and lag
Term = tuple[float, list[Var]]
LOG_2PIE = math.log(2 * math.pi * math.e)


def _lags(s: str, first: int, last: int) -> list[Var]:
    return [(s, k) for k in range(first, last + 1)]


def joint_terms() -> list[Term]:
    return [(1.0, [("x", 0), ("y", 0)])]


def conditional_terms() -> list[Term]:
    return [(1.0, [("x", 0), ("y", 0)]), (-1.0, [("x", 0)])]


def causal_terms(n: int) -> list[Term]:
    """H(y now | n past steps of y, x up to now)."""
    past = _lags("y", 1, n) + _lags("x", 0, n)
    return [(1.0, [("y", 0), *past]), (-1.0, past)]


def crossmap_terms(k: int) -> list[Term]:
    """H(y now | k past steps of x)."""
    return [(1.0, [("y", 0), *_lags("x", 1, k)]), (-1.0, _lags("x", 1, k))]


def directed_terms(n: int) -> list[Term]:
    own = _lags("y", 1, n)
    return [(1.0, [("y", 0), *own]), (-1.0, own)] + [(-w, v) for w, v in causal_terms(n)]


def interaction_terms() -> list[Term]:
    now, past = [("x", 0), ("y", 0)], [("x", 1), ("y", 1)]
    apart = [(1.0, [(s, 0), (s, 1)]) for s in "xy"] + [(-1.0, [(s, 1)]) for s in "xy"]
    return [*apart, (-1.0, now + past), (1.0, past)]


BLOCKS = range(1, 6)
ESTIMATORS = {"gaussian": "gaussian", "kozachenko": "kozachenko", "kernel": "kernel_W-0.5"}
# statistic prefix -> (suffix, list of (terms, history), averaged?)
TERM_FAMILIES = {
    "je": ("", [(joint_terms(), 0)]),
    "ce": ("", [(conditional_terms(), 0)]),
    "cce": ("", [(causal_terms(n), n) for n in BLOCKS]),
    "di": ("", [(directed_terms(n), n) for n in BLOCKS]),
    "si": ("_k-1", [(interaction_terms(), 1)]),
    "xme1": ("_k1", [(crossmap_terms(1), 1)]),
    "xme10": ("_k10", [(crossmap_terms(10), 10)]),
}
AVERAGED = {"cce"}


def term_values(family: str, estimators: list[str]):
    """Function of stacked series giving the statistic for each estimator."""
    blocks = TERM_FAMILIES[family][1]

    def fn(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out = {est: np.zeros(len(x)) for est in estimators}
        for terms, history in blocks:
            if x.shape[1] - history < 3:
                return {est: np.full(len(x), np.nan) for est in estimators}
            found = nb.entropies(x, y, [v for _, v in terms], history) if set(estimators) - {"gaussian"} else {}
            if "gaussian" in estimators:
                found["gaussian"] = [nb.entropy(nb.embed(x, y, v, history), "gaussian") for _, v in terms]
            for est in estimators:
                for (weight, _), value in zip(terms, found[est], strict=True):
                    out[est] += weight * value
        return {est: v / len(blocks) if family in AVERAGED else v for est, v in out.items()}

    return fn


def _by_terms(panel: DataFrame, family: str, directed: bool, estimators: list[str] | None = None) -> DataFrame:
    estimators = estimators or list(ESTIMATORS)
    past = any(history for _, history in TERM_FAMILIES[family][1])
    arrays = grid_arrays(panel, directed) if past else pair_arrays(panel, directed)
    m = map_arrays(arrays, PAIR, ["x", "y"], term_values(family, estimators), estimators)
    stem, suffix = family.rstrip("0123456789"), TERM_FAMILIES[family][0]
    return melt_stats(m, {f"{stem}_{ESTIMATORS[e]}{suffix}": F.col(e) for e in estimators})


def _gaussian_joint(m: DataFrame, name: str, conditional: bool) -> DataFrame:
    """Entropies from n-1 covariances; series are standardised, so variances are near 1."""
    d = F.col("n") - 1
    log_y = log_positive(ratio(F.col("sxx") * F.col("syy"), d * d) * (1 - F.col("r") * F.col("r")))
    joint = 0.5 * (2 * LOG_2PIE + log_y)
    own = 0.5 * (LOG_2PIE + log_positive(ratio(F.col("sxx"), d)))
    return melt_stats(m, {name: joint - own if conditional else joint})


def spi_je(panel: DataFrame) -> DataFrame:
    return _gaussian_joint(pair_moments(panel), "je_gaussian", False).unionByName(
        _by_terms(panel, "je", False, ["kozachenko", "kernel"])
    )


def spi_ce(panel: DataFrame) -> DataFrame:
    return _gaussian_joint(pair_moments(panel), "ce_gaussian", True).unionByName(
        _by_terms(panel, "ce", False, ["kozachenko", "kernel"])
    )


def spi_cce(panel: DataFrame) -> DataFrame:
    return _by_terms(panel, "cce", True)


def spi_xme(panel: DataFrame) -> DataFrame:
    return _by_terms(panel, "xme1", True).unionByName(_by_terms(panel, "xme10", True))


def spi_di(panel: DataFrame) -> DataFrame:
    return _by_terms(panel, "di", True)


def spi_si(panel: DataFrame) -> DataFrame:
    return _by_terms(panel, "si", False)


# ---- mutual information ----------------------------------------------------------------------


def _info_gain(joint: np.ndarray, parts: list[list[int]], k: int, window) -> np.ndarray:
    """Kraskov's first estimator: neighbours of the joint space counted in each part."""
    n = joint.shape[1]
    eps = nb.kth_distance(joint, k, window)
    ok = np.isfinite(eps).all(axis=1)
    eps = np.where(np.isfinite(eps), eps, 0.0)
    sums = sum(nb.digamma(nb.count_below(joint[:, :, p], eps, window) + 1) for p in parts)
    value = nb.digamma(np.array([k]))[0] + nb.digamma(np.array([n]))[0] - sums.mean(axis=1)
    return np.where(ok, value, np.nan)


def mutual_information(lag: int):
    def fn(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        window = np.maximum(nb.decorrelation_time(x), nb.decorrelation_time(y))
        v = nb.embed(x, y, [("x", lag), ("y", 0)], lag)
        p = [nb.share_within(v[:, :, c], 0.25) for c in ([0, 1], [0], [1])]
        return {
            "kraskov": _info_gain(v, [[0], [1]], 4, 0),
            "dce": _info_gain(v, [[0], [1]], 4, window),
            "kernel": np.log(p[0] / (p[1] * p[2])).mean(axis=1),
        }

    return fn


def _mi(panel: DataFrame, stem: str, lag: int, r: Column, moments: DataFrame) -> DataFrame:
    gauss = melt_stats(moments, {f"{stem}_gaussian": -0.5 * log_positive(1 - r * r)})
    arrays = grid_arrays(panel) if lag else pair_arrays(panel)
    m = map_arrays(arrays, PAIR, ["x", "y"], mutual_information(lag), ["kraskov", "dce", "kernel"])
    rest = {f"{stem}_kraskov_NN-4": F.col("kraskov"), f"{stem}_kraskov_NN-4_DCE": F.col("dce"), f"{stem}_kernel_W-0.25": F.col("kernel")}
    return gauss.unionByName(melt_stats(m, rest))


def spi_mi(panel: DataFrame) -> DataFrame:
    return _mi(panel, "mi", 0, F.col("r"), pair_moments(panel))


def delay_points(panel: DataFrame, directed: bool) -> DataFrame:
    """Rows ``x0, y0, y1``: both series at t and y one step later; all NULL where one of them is missing."""
    a = grid_arrays(panel, directed)
    n = F.size("x") - 1
    cols = [F.slice("x", F.lit(1), n).alias("x0"), F.slice("y", F.lit(1), n).alias("y0"), F.slice("y", F.lit(2), n).alias("y1")]
    return a.where(F.size("x") > 1).select(*PAIR, *cols).select(*PAIR, F.inline(F.arrays_zip("x0", "y0", "y1"))).select(
        *PAIR, *[F.when(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull(), F.col(c)).alias(c) for c in ("x0", "y0", "y1")]
    )


def spi_tlmi(panel: DataFrame) -> DataFrame:
    m = delay_points(panel, False).groupBy(*PAIR).agg(pearson(F.col("x0"), F.col("y1")).alias("r"))
    return _mi(panel, "tlmi", 1, F.col("r"), m)


# ---- transfer entropy ------------------------------------------------------------------------


def _transfer_kraskov(x, y, k_history, window):
    """I(y now; x past | y past) by neighbours of the joint space."""
    v = nb.embed(x, y, [("y", 0), ("x", 1), *_lags("y", 1, k_history)], k_history)
    past = list(range(2, v.shape[2]))
    eps = nb.kth_distance(v, 4, window)
    ok = np.isfinite(eps).all(axis=1)
    eps = np.where(np.isfinite(eps), eps, 0.0)
    n_yp, n_xp, n_p = (nb.digamma(nb.count_below(v[:, :, c], eps, window) + 1) for c in ([0, *past], [1, *past], past))
    value = nb.digamma(np.array([4]))[0] - (n_yp + n_xp - n_p).mean(axis=1)
    return np.where(ok, value, np.nan)


def transfer_neighbours(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    window = np.maximum(nb.decorrelation_time(x), nb.decorrelation_time(y))
    return {
        "k2_dce": _transfer_kraskov(x, y, 2, window),
        "k1_dce": _transfer_kraskov(x, y, 1, window),
        "k1": _transfer_kraskov(x, y, 1, 0),
    }


K_MAX, TAU_MAX = 10, 4  # histories that are tried
LEAST_POINTS = 12  # points that a history must leave


def best_history(x: np.ndarray) -> dict[str, np.ndarray]:
    """The history (k steps, tau apart) that stores most information about a series' next step, by neighbours, with and without the excluded window; the shorter of equal ones.

    Stored information is corrected for its number of terms, so longer histories must earn it.
    """
    b, n = x.shape
    window = nb.decorrelation_time(x)
    best = {w: np.full(b, -np.inf) for w in ("", "_dce")}
    out = {f"{name}{w}": np.ones(b) for w in best for name in ("k", "tau")}
    for k in range(1, K_MAX + 1):
        for tau in range(1, TAU_MAX + 1):
            start = (k - 1) * tau + 1
            if (k == 1 and tau > 1) or n - start < LEAST_POINTS:
                continue
            v = nb.embed(x, x, [("x", 0), *[("x", 1 + j * tau) for j in range(k)]], start)
            for w, bar in (("", 0), ("_dce", window)):
                stored = np.nan_to_num(_info_gain(v, [[0], list(range(1, k + 1))], 4, bar) - k / (2 * (n - start)), nan=-np.inf)
                better = stored > best[w] + 1e-12
                best[w] = np.where(better, stored, best[w])
                out[f"k{w}"], out[f"tau{w}"] = np.where(better, k, out[f"k{w}"]), np.where(better, tau, out[f"tau{w}"])
    return out


def transfer_histories(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
    """I(y now; history of x | history of y); ``e`` holds k and tau of x, then of y, without and with the excluded window."""
    n = x.shape[1]
    window = np.maximum(nb.decorrelation_time(x), nb.decorrelation_time(y))
    out = {"plain": np.full(len(x), np.nan), "dce": np.full(len(x), np.nan)}
    for name, at, bar in (("plain", 0, np.zeros(len(x), int)), ("dce", 4, window)):
        for kx, tx, ky, ty in np.unique(e[:, at : at + 4].astype(int), axis=0).tolist():
            rows = np.flatnonzero((e[:, at : at + 4] == (kx, tx, ky, ty)).all(axis=1))
            start = max((kx - 1) * tx, (ky - 1) * ty) + 1
            if n - start < 6:
                continue
            source, own = [("x", 1 + j * tx) for j in range(kx)], [("y", 1 + j * ty) for j in range(ky)]
            v = nb.embed(x[rows], y[rows], [("y", 0), *source, *own], start)
            of_x, of_y = list(range(1, kx + 1)), list(range(kx + 1, kx + ky + 1))
            eps = nb.kth_distance(v, 4, bar[rows])
            ok = np.isfinite(eps).all(axis=1)
            eps = np.where(np.isfinite(eps), eps, 0.0)
            joint, other, past = (nb.digamma(nb.count_below(v[:, :, c], eps, bar[rows]) + 1) for c in ([0, *of_y], [*of_x, *of_y], of_y))
            out[name][rows] = np.where(ok, nb.digamma(np.array([4]))[0] - (joint + other - past).mean(axis=1), np.nan)
    return out


def spi_te_kraskov_auto(panel: DataFrame) -> DataFrame:
    """Transfer entropy by neighbours with the histories that each series' own stored information chooses, once for a series."""
    names = ["k", "tau", "k_dce", "tau_dce"]
    series = series_grid(panel).select("sample_id", "node", F.expr("transform(cells, c -> c.v)").alias("x"))
    chosen = map_arrays(series, ["sample_id", "node"], ["x"], best_history, names, power=2)
    pairs = grid_arrays(panel, True)
    for side in ("from", "to"):
        own = chosen.select("sample_id", F.col("node").alias(f"node_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in names])
        pairs = pairs.join(own, ["sample_id", f"node_{side}"], "left")
    e = F.array(*[F.col(f"{c}{w}_{side}") for w in ("", "_dce") for side in ("from", "to") for c in ("k", "tau")])
    m = map_arrays(pairs.withColumn("e", e), PAIR, ["x", "y", "e"], transfer_histories, ["plain", "dce"])
    return melt_stats(m, {f"te_kraskov_NN-4_k-max-{K_MAX}_tau-max-{TAU_MAX}": F.col("plain"), f"te_kraskov_NN-4_DCE_k-max-{K_MAX}_tau-max-{TAU_MAX}": F.col("dce")})


def spi_te_kraskov(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, True), PAIR, ["x", "y"], transfer_neighbours, ["k2_dce", "k1_dce", "k1"])
    return melt_stats(
        m,
        {
            "te_kraskov_NN-4_DCE_k-2_kt-1_l-1_lt-1": F.col("k2_dce"),
            "te_kraskov_NN-4_DCE_k-1_kt-1_l-1_lt-1": F.col("k1_dce"),
            "te_kraskov_NN-4_k-1_kt-1_l-1_lt-1": F.col("k1"),
        },
    )


def transfer_kernel(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    v = nb.embed(x, y, [("y", 0), ("y", 1), ("x", 1)], 1)
    p = [nb.share_within(v[:, :, c], 0.25) for c in ([0, 1, 2], [1], [0, 1], [1, 2])]
    return {"v": np.log(p[0] * p[1] / (p[2] * p[3])).mean(axis=1)}


def spi_te_kernel(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, True), PAIR, ["x", "y"], transfer_kernel, ["v"])
    return melt_stats(m, {"te_kernel_W-0.25_k-1": F.col("v")})


def _count_sums(*codes: np.ndarray) -> np.ndarray:
    """Sum of n ln n over the distinct combinations of the codes, per batch row."""
    b, m = codes[0].shape
    key = np.repeat(np.arange(b), m)
    for c in codes:
        _, dense = np.unique(c, return_inverse=True)
        key = np.unique(key * (dense.max() + 1) + dense.reshape(-1), return_inverse=True)[1].reshape(-1)
    n = np.bincount(key)
    row = np.zeros(len(n), dtype=int)
    row[key] = np.repeat(np.arange(b), m)
    return np.bincount(row, weights=n * np.log(n), minlength=b)


def symbolic_transfer(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Plug-in transfer entropy of order patterns; a history of k uses patterns of k + 1 values.

    Equal values count as rising, so a pattern is always defined.
    """
    b, n = x.shape
    rise_x, rise_y = x[:, 1:] >= x[:, :-1], y[:, 1:] >= y[:, :-1]
    out = {}
    for k in (1, 10):
        m = n - k - 1
        if m < 2:
            out[f"k{k}"] = np.full(b, np.nan)
            continue
        order = np.argsort(np.lib.stride_tricks.sliding_window_view(y, k + 1, axis=1), axis=2, kind="stable")
        past = (order * (k + 1) ** np.arange(k + 1, dtype=np.int64)).sum(axis=2)[:, :m]
        nxt, src = rise_y[:, k : k + m], rise_x[:, k - 1 : k - 1 + m]
        out[f"k{k}"] = (_count_sums(past, nxt, src) + _count_sums(past) - _count_sums(past, nxt) - _count_sums(past, src)) / m
    return out


def spi_te_symbolic(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, directed=True, value="signal"), PAIR, ["x", "y"], symbolic_transfer, ["k1", "k10"], power=1)
    return melt_stats(m, {f"te_symbolic_k-{k}_kt-1_l-1_lt-1": F.col(f"k{k}") for k in (1, 10)})


def spi_gc_gaussian(panel: DataFrame) -> DataFrame:
    """Half the log ratio of the residual variances of y without and with x, one step back."""
    x0, y0, y1 = F.col("x0"), F.col("y0"), F.col("y1")
    m = delay_points(panel, True).groupBy(*PAIR).agg(
        pearson(y0, y1).alias("a"), pearson(x0, y1).alias("b"), pearson(x0, y0).alias("c")
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    det = 1 + 2 * a * b * c - a * a - b * b - c * c
    return melt_stats(m, {"gc_gaussian_k-1_kt-1_l-1_lt-1": 0.5 * log_positive(ratio((1 - a * a) * (1 - c * c), F.when(det > 1e-12, det)))})


def granger_best_history(x: np.ndarray, y: np.ndarray, k_max: int = 10, tau_max: int = 2) -> dict[str, np.ndarray]:
    """Granger causality with the history (k, tau) of y that stores most information about its next step.

    Stored information is corrected for its number of terms, so longer histories must earn it.
    """
    b, n = x.shape
    best, value = np.full(b, -np.inf), np.full(b, np.nan)
    for tau in range(1, tau_max + 1):
        for k in range(1, k_max + 1):
            start = (k - 1) * tau + 1
            if n - start < 2 * k + 5:
                continue
            own = [("y", 1 + j * tau) for j in range(k)]
            other = [("x", 1 + j * tau) for j in range(k)]
            h = {name: nb.entropy(nb.embed(x, y, v, start), "gaussian") for name, v in (
                ("n", [("y", 0)]), ("o", own), ("no", [("y", 0), *own]), ("oo", own + other), ("noo", [("y", 0), *own, *other])
            )}
            stored = h["n"] + h["o"] - h["no"] - k / (2 * (n - start))
            gain = (h["no"] - h["o"]) - (h["noo"] - h["oo"])
            better = np.nan_to_num(stored, nan=-np.inf) > best + 1e-12
            best, value = np.where(better, stored, best), np.where(better, gain, value)
    return {"v": value}


def spi_gc_gaussian_auto(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, True), PAIR, ["x", "y"], granger_best_history, ["v"], power=1)
    return melt_stats(m, {"gc_gaussian_k-max-10_tau-max-2": F.col("v")})
