"""Pairing the channels of a sample.

Series are packed into arrays of consecutive steps before they are joined. The join key is
(sample, block of time), so a long sample spreads over many tasks, each side is shuffled once as
compact arrays, and the points of a pair are unpacked next to each other, where map-side
combine reduces a whole block to one row. ``node_blocks`` additionally salts the nodes of a sample:
each series is sent to ``node_blocks`` partners' buckets, so that one sample with very many
channels is spread too. Adaptive execution splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.operators.shared import shared

PAIR = ["sample_id", "node_from", "node_to"]


@shared(written=True)
def series_arrays(panel: DataFrame, value: str = "z", block: int | None = None) -> DataFrame:
    """One row per series (or per block of ``block`` steps): times and values in time order."""
    keys = ["sample_id", "node"]
    df = panel.select(*keys, "t", F.col(value).cast("double").alias("v"))
    df = df.withColumn("blk", F.floor(F.col("t") / block) if block else F.lit(0).cast("long"))
    packed = df.groupBy(*keys, "blk").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return packed.select(*keys, "blk", F.col("s.t").alias("ts"), F.col("s.v").alias("vs"))


def _node_keys(series: DataFrame, side: str, node_blocks: int) -> DataFrame:
    own = F.pmod(F.xxhash64("node"), F.lit(node_blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(node_blocks - 1)))
    mine, theirs = ("ka", "kb") if side == "a" else ("kb", "ka")
    return series.withColumn(mine, own.cast("int")).withColumn(theirs, other)


@shared(written=False)
def pair_arrays(
    panel: DataFrame,
    directed: bool = False,
    value: str = "z",
    block: int | None = None,
    node_blocks: int = 1,
    include_self: bool = False,
) -> DataFrame:
    """One row per pair of series with aligned arrays ``ts, x, y``.

    Undirected pairs keep ``node_from < node_to``. Steps that only one side has are left out.
    """
    series = series_arrays(panel, value, block)
    return join_series(series, directed, node_blocks, include_self).select(*PAIR, *aligned())


def join_series(series: DataFrame, directed: bool, node_blocks: int = 1, include_self: bool = False) -> DataFrame:
    """Equi-join of packed series on sample, block and salt; other columns get suffix _a or _b."""
    keys = ["sample_id", "blk"]
    a, b = series, series
    if node_blocks > 1:
        a, b = _node_keys(a, "a", node_blocks), _node_keys(b, "b", node_blocks)
        keys += ["ka", "kb"]
    names = [c for c in series.columns if c not in ("sample_id", "blk", "node")]
    a = a.select(*keys, F.col("node").alias("node_from"), *[F.col(c).alias(f"{c}_a") for c in names])
    b = b.select(*keys, F.col("node").alias("node_to"), *[F.col(c).alias(f"{c}_b") for c in names])
    out = a.join(b, keys)
    if include_self and directed:
        return out
    if include_self:
        return out.where("node_from <= node_to")
    return out.where("node_from <> node_to" if directed else "node_from < node_to")


def aligned() -> list:
    shared = "array_intersect(ts_a, ts_b)"
    same = "ts_a = ts_b"
    pick = "transform({s}, t -> vs_{k}[cast(array_position(ts_{k}, t) as int) - 1])"
    return [
        F.expr(f"CASE WHEN {same} THEN ts_a ELSE {shared} END").alias("ts"),
        F.expr(f"CASE WHEN {same} THEN vs_a ELSE {pick.format(s=shared, k='a')} END").alias("x"),
        F.expr(f"CASE WHEN {same} THEN vs_b ELSE {pick.format(s=shared, k='b')} END").alias("y"),
    ]


def pair_self_join(
    panel: DataFrame,
    directed: bool = False,
    value: str = "z",
    block: int = 4096,
    node_blocks: int = 1,
    include_self: bool = False,
) -> DataFrame:
    """All channel pairs of a sample aligned on time: ``sample_id, node_from, node_to, t, x, y``."""
    arrays = pair_arrays(panel, directed, value, block, node_blocks, include_self)
    return arrays.select(*PAIR, F.inline(F.arrays_zip("ts", "x", "y"))).withColumnRenamed("ts", "t")


@shared(written=True)
def series_grid(panel: DataFrame, value: str = "z") -> DataFrame:
    """One row per series: its first step, and a cell for every step up to its last, NULL where the series has none.

    ``t`` must be a whole number and occur once in a series.
    """
    gap = "cast(coalesce(try_element_at(ts, i + 2) - t, 1) as int) - 1"
    cells = f"flatten(transform(ts, (t, i) -> concat(array(named_struct('v', vs[i])), array_repeat(cast(NULL as struct<v: double>), {gap}))))"
    return series_arrays(panel, value).select("sample_id", "node", "blk", F.expr("ts[0]").alias("first"), F.expr(cells).alias("cells"))


@shared(written=False)
def grid_arrays(panel: DataFrame, directed: bool = False, value: str = "z") -> DataFrame:
    """Pairs with arrays ``x, y`` over the steps between the first and last that both series span, one place per step.

    A step that a series lacks is NULL, so places shifted by a lag are steps shifted by that lag.
    """
    j = join_series(series_grid(panel, value), directed)
    j = j.withColumn("lo", F.greatest("first_a", "first_b"))
    j = j.withColumn("n", F.expr("cast(greatest(0, least(first_a + size(cells_a), first_b + size(cells_b)) - lo) as int)"))
    part = "transform(slice(cells_{s}, cast(lo - first_{s} + 1 as int), n), c -> c.v)"
    return j.select(*PAIR, F.expr(part.format(s="a")).alias("x"), F.expr(part.format(s="b")).alias("y"))


def lag_self_join(panel: DataFrame, lags: list[int], directed: bool = True, value: str = "z") -> DataFrame:
    """Pairs of points ``x[t], y[t + lag]`` for a short list of lags; a point whose partner is missing is left out."""
    j = join_series(series_grid(panel, value), directed).withColumn("lag", F.explode(F.array(*[F.lit(l) for l in lags])))
    j = j.withColumn("d", F.expr("cast(first_a + lag - first_b as int)"))
    j = j.withColumns({"sx": F.expr("greatest(0, -d)"), "sy": F.expr("greatest(0, d)")})
    j = j.withColumn("n", F.expr("greatest(0, least(size(cells_a) - sx, size(cells_b) - sy))"))
    meet = F.expr("zip_with(slice(cells_a, sx + 1, n), slice(cells_b, sy + 1, n), (p, q) -> named_struct('p', p, 'q', q))")
    pts = j.select(*PAIR, "lag", "first_a", "sx", F.posexplode(meet).alias("at", "m")).where("m.p IS NOT NULL AND m.q IS NOT NULL")
    return pts.select(*PAIR, "lag", (F.col("first_a") + F.col("sx") + F.col("at")).alias("t"), F.col("m.p.v").alias("x"), F.col("m.q.v").alias("y"))


def melt_stats(df: DataFrame, stats: dict, keys: list[str] = PAIR) -> DataFrame:
    """Columns to long form: one row per statistic with ``spi`` and ``value``."""
    rows = [F.struct(F.lit(n).alias("spi"), c.cast("double").alias("value")) for n, c in stats.items()]
    return df.select(*keys, F.inline(F.array(*rows))).select("spi", *keys, "value")
