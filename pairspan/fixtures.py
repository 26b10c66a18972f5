"""Panels derived from the shared tables.

A *panel* is the long table every estimator reads: one row per sample, node and time step, with
columns ``sample_id, grp, node, t, signal`` (and ``z`` once standardised).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspan.operators.windows import zscore_series

# The channels and the time range of the event panel.
EVENT_NODES = ("click", "error", "purchase", "signup", "view")
EVENT_DAYS = 30
# The channels (return flag, line status) and months of the shipment panel.
SHIP_NODES = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")

# The channels (order priorities) of the order panel.
ORDER_NODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_panel(observed: DataFrame, keys: list[str], nodes: tuple[str, ...], first_t: int, last_t: int) -> DataFrame:
    """Zero-filled dense panel from sparse amounts ``keys, node, t, q``.

    The grid rows are unioned with the observations and summed, so filling costs one aggregation
    with map-side combine and no join.
    """
    grid = (
        observed.select(*keys)
        .distinct()
        .withColumn("node", F.explode(F.array(*[F.lit(n) for n in nodes])))
        .withColumn("t", F.explode(F.sequence(F.lit(first_t), F.lit(last_t))))
        .withColumn("q", F.lit(0.0))
    )
    return (
        observed.select(*keys, "node", "t", "q")
        .unionByName(grid)
        .groupBy(*keys, "node", "t")
        .agg(F.round(F.sum("q"), 2).alias("signal"))
    )


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample_id"),
        (F.col("user_id") % 4).cast("string").alias("grp"),
        (F.col("user_id") % 29).cast("string").alias("subject"),
        F.col("event_type").alias("node"),
        (F.dayofmonth("ts") - 1).alias("t"),
        F.col("value").alias("q"),
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value per user and event type; grows with the ``events`` table."""
    return fill_panel(_event_rows(spark, sf_dir), ["sample_id", "grp", "subject"], EVENT_NODES, 0, EVENT_DAYS - 1)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the samples, straight from the source rows (no panel needed)."""
    return sample_metadata(_event_rows(spark, sf_dir))


def event_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore_series(event_panel(spark, sf_dir))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped quantity per customer nation and (return flag, line status)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    seen = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(
            F.col("n_name").alias("sample_id"),
            F.col("r_name").alias("grp"),
            F.concat_ws("_", "l_returnflag", "l_linestatus").alias("node"),
            month.alias("t"),
        )
        .agg(F.sum("l_quantity").alias("q"))
    )
    return fill_panel(seen, ["sample_id", "grp"], SHIP_NODES, 0, 83)


def ship_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore_series(ship_panel(spark, sf_dir))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value per customer nation and order priority."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer, nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation")
    seen = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("sample_id"),
            F.col("o_orderpriority").alias("node"),
            ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("t"),
            F.col("o_totalprice").alias("q"),
        )
    )
    return fill_panel(seen, ["sample_id"], ORDER_NODES, 0, 79)


def order_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zscore_series(order_panel(spark, sf_dir))


def sample_metadata(panel: DataFrame) -> DataFrame:
    return panel.select("sample_id", "grp", "subject").distinct()


def spi_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of pair statistics, self-pairs included.

    It holds one directed and several undirected statistics, a constant one, one that only some
    samples have, and one that no list names, so that every quality rule has something to drop.
    """
    from pairspan.operators.pairs import PAIR, melt_stats, pair_arrays

    dot = "aggregate(zip_with({a}, {b}, (p, q) -> {f}), 0D, (s, v) -> s + v) / size({a})"
    lag_x, lag_y = "slice(x, 1, size(x) - 1)", "slice(y, 2, size(y) - 1)"
    stats = pair_arrays(event_z(spark, sf_dir), directed=True, include_self=True).select(
        *PAIR,
        F.expr(dot.format(a="x", b="y", f="p * q")).alias("c"),
        F.expr(dot.format(a="x", b="y", f="abs(p - q)")).alias("d"),
        F.expr(dot.format(a=lag_x, b=lag_y, f="p * q")).alias("l"),
    )
    other = F.col("node_from") != F.col("node_to")
    strong = F.when(other & (F.abs("c") > 1.96 / EVENT_DAYS**0.5), F.col("c"))
    long = melt_stats(
        stats,
        {
            "cov": F.col("c"),
            "cityblock": F.col("d"),
            "lag1": F.col("l"),
            "constant": F.lit(1.0),
            "significant": strong,
            "unlisted": F.col("d"),
        },
    )
    return long.where("spi <> 'significant' OR value IS NOT NULL")


def spi_info(spark: SparkSession) -> DataFrame:
    """Dimension of the statistics in :func:`spi_fact` (fixed values)."""
    rows = [
        ("cov", "Undirected", "basic", "M01"),
        ("cityblock", "Undirected", "distance", "M01"),
        ("lag1", "Directed", "basic", "M02"),
        ("constant", "Undirected", "misc", None),
        ("significant", "Undirected", "distance", "M02"),
    ]
    return spark.createDataFrame(rows, "spi string, directionality string, category string, module string")


def accuracy_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Accuracy-shaped shares: supplier = statistic, line status = problem, year = resample, month = permutation."""
    hit = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("spi"),
        F.col("l_linestatus").alias("problem"),
        F.year("l_shipdate").alias("resample"),
        F.month("l_shipdate").alias("perm"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("ok"),
    )
    acc = hit.groupBy("spi", "problem", "resample").agg(F.avg("ok").alias("accuracy"))
    nul = hit.groupBy("spi", "problem", "perm").agg(F.avg("ok").alias("null_accuracy"))
    return acc, nul


def supplier_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and module of the statistics in :func:`accuracy_tables`; some have no category."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("spi"),
            F.when(F.col("s_acctbal") >= 0, F.col("r_name")).alias("category"),
            F.col("n_name").alias("module"),
        )
    )


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a study of statistics: label = dataset, dimension = statistic, vector = node pair."""
    dims = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("dim", "value"))
    return dims.select(
        F.col("label").cast("string").alias("sample_id"),
        F.format_string("d%02d", "dim").alias("node"),
        F.col("vec_id").alias("t"),
        F.col("value").cast("double").alias("signal"),
    )
