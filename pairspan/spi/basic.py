"""Covariance, precision, rank correlation and cross-correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, group_starts, local_codes, map_whole
from pairspan.functions.numeric import pearson, ratio
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats, pair_arrays, pair_self_join
from pairspan.operators.shared import shared

LINEAR = ("EmpiricalCovariance", "ShrunkCovariance", "OAS", "LedoitWolf")


@shared(written=True)
def pair_moments(panel: DataFrame, directed: bool = False, **kw) -> DataFrame:
    """Second moments of every pair: the shared input of all linear statistics."""
    x, y = F.col("x"), F.col("y")
    both = x.isNotNull() & y.isNotNull()

    def s(c: Column) -> Column:
        return F.sum(F.when(both, c))

    return (
        pair_self_join(panel, directed, **kw)
        .groupBy(*PAIR)
        .agg(
            F.count(F.when(both, 1)).alias("n"),
            s(x * x).alias("sxx"),
            s(y * y).alias("syy"),
            s(x * y).alias("sxy"),
            pearson(x, y).alias("r"),
        )
    )


def _both(name: str, value: Column, kind: str) -> dict[str, Column]:
    return {f"{kind}_{name}": value, f"{kind}-sq_{name}": value * value}


def spi_cov(panel: DataFrame) -> DataFrame:
    return melt_stats(pair_moments(panel), _both("EmpiricalCovariance", F.col("r"), "cov"))


def spi_cov_shrunk(panel: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    return melt_stats(pair_moments(panel), _both("ShrunkCovariance", (1 - shrinkage) * F.col("r"), "cov"))


def shrinkage_per_sample(panel: DataFrame, moments: DataFrame) -> DataFrame:
    """Closed-form shrinkage intensities from sums over the cells of each sample's matrix."""
    t = F.count("z").alias("n_t")
    series = panel.groupBy("sample_id", "node").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), t).where("zz IS NOT NULL")
    diag = series.select("sample_id", "n_t", (F.col("zz") / F.col("n_t")).alias("s_ii")).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("p"), F.max("n_t").alias("n_t"), F.sum("s_ii").alias("trace"), F.sum(F.col("s_ii") * F.col("s_ii")).alias("diag2")
    )
    cell = F.col("sxy") / F.col("n")
    off = moments.where("n > 0").groupBy("sample_id").agg((2 * F.sum(cell * cell)).alias("off2"))
    by_t = panel.groupBy("sample_id", "t").agg(F.sum(F.col("z") * F.col("z")).alias("q"))
    fourth = by_t.groupBy("sample_id").agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    d = diag.join(off, "sample_id").join(fourth, "sample_id")
    p, n, mu = F.col("p"), F.col("n_t"), F.col("trace") / F.col("p")
    all2 = F.col("diag2") + F.col("off2")
    alpha = all2 / (p * p)
    oas = F.least(F.lit(1.0), F.coalesce(ratio(alpha + mu * mu, (n + 1) * (alpha - mu * mu / p)), F.lit(1.0)))
    delta = (all2 - p * mu * mu) / p
    beta = F.least(delta, (F.col("q2") / n - all2) / (p * n))
    return d.select("sample_id", mu.alias("mu"), oas.alias("OAS"), F.coalesce(ratio(beta, delta), F.lit(0.0)).alias("LedoitWolf"))


@shared(written=True)
def sample_shrinkage(panel: DataFrame) -> DataFrame:
    """``sample_id, mu, OAS, LedoitWolf`` of a panel: what all shrunk statistics share."""
    return shrinkage_per_sample(panel, pair_moments(panel))


def _shrunk(panel: DataFrame, name: str) -> DataFrame:
    out = pair_moments(panel).join(sample_shrinkage(panel), "sample_id")
    return melt_stats(out, _both(name, (1 - F.col(name)) * F.col("sxy") / F.nullif(F.col("n"), F.lit(0)), "cov"))


def spi_cov_oas(panel: DataFrame) -> DataFrame:
    return _shrunk(panel, "OAS")


def spi_cov_ledoitwolf(panel: DataFrame) -> DataFrame:
    return _shrunk(panel, "LedoitWolf")


def inverses(table: pa.Table) -> pa.Table:
    """Cells of the inverses of whole samples, those with as many nodes at once; NULL where a matrix is singular."""
    starts = group_starts(table, ["sample_id"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    _, there, (i, j) = local_codes(group, len(starts), table["node_from"], table["node_to"])
    width = there.sum(axis=1)
    cell = {c: table[c].to_numpy() for c in ("s_ij", "s_ii", "s_jj", "OAS", "LedoitWolf")}
    out = {n: np.full(table.num_rows, np.nan) for n in LINEAR}
    for p in np.unique(width):
        own = np.flatnonzero(width == p)
        step = max(1, int(CELLS // p**2))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            rows = np.flatnonzero(np.isin(group, part))
            at, a, b = np.searchsorted(part, group[rows]), i[rows], j[rows]
            s = np.zeros((len(part), p, p))
            s[at, a, b] = s[at, b, a] = cell["s_ij"][rows]
            s[at, a, a], s[at, b, b] = cell["s_ii"][rows], cell["s_jj"][rows]
            mu = np.trace(s, axis1=1, axis2=2) / p
            first = starts[part]
            shares = {"EmpiricalCovariance": np.zeros(len(part)), "ShrunkCovariance": np.full(len(part), 0.1), "OAS": cell["OAS"][first], "LedoitWolf": cell["LedoitWolf"][first]}
            for name, share in shares.items():
                m = (1 - share)[:, None, None] * s + (share * mu)[:, None, None] * np.eye(p)
                full = np.linalg.matrix_rank(m) == p
                inv = np.linalg.inv(np.where(full[:, None, None], m, np.eye(p)))
                out[name][rows] = np.where(full[at], inv[at, a, b], np.nan)
    return pa.table({**{k: table[k] for k in PAIR}, **{n: pa.array(v, from_pandas=True) for n, v in out.items()}})


def spi_prec(panel: DataFrame) -> DataFrame:
    """Inverse of each sample's node-by-node matrix; only moments reach the inversion."""
    moments = pair_moments(panel).where("n > 0")
    cells = moments.select(*PAIR, (F.col("sxy") / F.col("n")).alias("s_ij"), (F.col("sxx") / F.col("n")).alias("s_ii"), (F.col("syy") / F.col("n")).alias("s_jj"))
    cells = cells.join(sample_shrinkage(panel).drop("mu"), "sample_id")
    schema = "sample_id string, node_from string, node_to string, " + ", ".join(f"{n} double" for n in LINEAR)
    inv = map_whole(cells, ["sample_id"], inverses, schema)
    stats: dict[str, Column] = {}
    for n in LINEAR:
        stats |= _both(n, F.col(n), "prec")
    return melt_stats(inv, stats)


def average_ranks(panel: DataFrame, value: str = "signal") -> DataFrame:
    """Rank of every point in its series, ties averaged.

    Equal values are counted first, so the running sum orders distinct values, not points.
    """
    keys = ["sample_id", "node"]
    counts = panel.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    ranks = counts.select(*keys, value, (run - (F.col("n") - 1) / 2).alias("rank"))
    return panel.join(ranks, [*keys, value])


def spi_spearman(panel: DataFrame) -> DataFrame:
    m = pair_self_join(average_ranks(panel), value="rank").groupBy(*PAIR).agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return melt_stats(m, {"spearmanr": F.col("r"), "spearmanr-sq": F.col("r") * F.col("r")})


def cross_correlation(arrays: DataFrame) -> DataFrame:
    """Adds ``c``: the cross-correlation at every lag with abs(lag) < T/4, computed inside the pair's row."""
    n = "size(x)"
    # a sum over steps of x[t] * y[t + l], divided by the number of steps that both have; missing steps are skipped
    one = (
        f"aggregate(zip_with(slice(x, 1 + greatest(-l, 0), {n} - abs(l)), slice(y, 1 + greatest(l, 0), {n} - abs(l)), "
        f"(a, b) -> a * b), cast(NULL as double), (s, v) -> coalesce(s + v, s, v)) / nullif(held, 0)"
    )
    top = f"(cast(ceil({n} / 4) as int) - 1)"
    arrays = arrays.withColumn("held", F.expr("size(filter(zip_with(x, y, (a, b) -> a * b), v -> v IS NOT NULL))"))
    return arrays.withColumn("c", F.expr(f"transform(sequence(-greatest({top}, 0), greatest({top}, 0)), l -> {one})"))


def spi_xcorr(panel: DataFrame, bar: float = 1.96) -> DataFrame:
    """Means and maxima over lags; a lag is significant beyond ``bar`` / sqrt(T)."""
    cc = cross_correlation(grid_arrays(panel))
    strong = F.expr(f"filter(c, v -> abs(v) > {bar}D / sqrt(held))")
    cc = cc.select(*PAIR, F.expr("filter(c, v -> v IS NOT NULL)").alias("c"), strong.alias("sig"))
    stats = {}
    for tag, power in (("", "v"), ("-sq", "v * v")):
        stats[f"xcorr{tag}_max_sig-True"] = F.expr(f"array_max(transform(sig, v -> {power}))")
        for flag, col in (("True", "sig"), ("False", "c")):
            total = f"aggregate({col}, 0D, (s, v) -> s + {power})"
            stats[f"xcorr{tag}_mean_sig-{flag}"] = F.expr(f"try_divide({total}, cast(size({col}) as double))")
    return melt_stats(cc, stats)


def spi_kendall(panel: DataFrame) -> DataFrame:
    from pairspan.functions.batches import map_arrays

    tau = map_arrays(pair_arrays(panel, value="signal"), PAIR, ["x", "y"], kendall_tau, ["tau"])
    return melt_stats(tau, {"kendalltau": F.col("tau"), "kendalltau-sq": F.col("tau") * F.col("tau")})


def kendall_tau(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """tau-b: agreements of order minus disagreements, corrected for ties."""
    from pairspan.functions.batches import row_blocks

    b, n = x.shape
    agree, mx, my = np.zeros(b), np.zeros(b), np.zeros(b)
    for rows in row_blocks(b, n):
        sx = np.sign(x[:, rows, None] - x[:, None, :])
        sy = np.sign(y[:, rows, None] - y[:, None, :])
        agree += (sx * sy).sum(axis=(1, 2))
        mx += np.abs(sx).sum(axis=(1, 2))
        my += np.abs(sy).sum(axis=(1, 2))
    return {"tau": agree / np.sqrt(mx * my)}
