"""Sources and sinks: tables are written to the shared folder, read back, and compared with their origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairspan import fixtures as fx
from pairspan.functions.numeric import rounded
from pairspan.operators import reshape, windows
from pairspan.operators.pairs import PAIR
from pairspan.plans import catalog
from pairspan.session import fresh_path
from pairspan.sources import files
from pairspan.streaming.incremental import skip_existing
from pairspan.workloads.registry import query
from pairspan.workloads.spi_time import _CDS, _MOM, melt
from pairspan.workloads.sqltext import EV, PU, SHIP, SPI, r6, with_

NODES = list(fx.EVENT_NODES)


@query(
    "scan_wide_series",
    with_(
        SHIP,
        "SELECT m.node, m.grp AS cls, m.t, m.signal, d.id FROM mts m JOIN (SELECT sample_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY sample_id) AS INTEGER) AS id "
        "FROM (SELECT DISTINCT sample_id, grp FROM mts)) d ON m.sample_id = d.sample_id",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "wide")
    s = fx.ship_panel(spark, sf).groupBy("sample_id", "grp", "node").agg(F.array_sort(F.collect_list(F.struct("t", "signal"))).alias("s"))
    body = s.select("node", "grp", "sample_id", F.concat(F.array_join(F.col("s.signal").cast("array<string>"), ","), F.lit(","), "grp").alias("value"))
    head = body.select("node", "grp").distinct().select("node", "grp", F.lit("").alias("sample_id"), F.explode(F.array(F.lit("@relation series"), F.lit("% made here"))).alias("value"))
    lines = body.unionByName(head).repartition("node", "grp").sortWithinPartitions("node", "grp", "sample_id")
    lines.select("value", "node", "grp").write.partitionBy("node", "grp").text(path)
    rows = files.scan_wide_series(spark, path, "node string, grp string")
    ids = windows.row_number_id(rows, "file", "line").select("node", "cls", "id", "values")
    return reshape.series_to_long(ids).select("node", "cls", "t", "signal", "id")


def _daily(spark, sf) -> DataFrame:
    return reshape.to_wide(fx.event_panel(spark, sf), ["sample_id", "t"], "node", "signal", NODES)


@query("scan_headerless_csv", with_(EV, "SELECT CAST(sample_id AS INTEGER) AS sample, t, node, signal FROM ev"))
def _(spark, sf):
    path = fresh_path(spark, "plain")
    _daily(spark, sf).select(F.col("sample_id"), "t", *NODES).write.csv(path)
    order = Window.orderBy("node")  # a row per channel
    lookup = fx.table(spark, sf, "events").select(F.col("event_type").alias("node")).distinct().withColumn("ordinal", F.row_number().over(order))
    return files.scan_headerless_lookup(spark, path, lookup, len(NODES), "sample int, t int")


@query(
    "scan_file_pattern",
    with_(EV, "SELECT concat('sub-', subject) AS subject, concat('scan', grp) AS scan, 'S1' AS session, t, node, round(sum(signal), 2) AS signal FROM ev WHERE CAST(subject AS INTEGER) < 10 GROUP BY 1, 2, 4, 5"),
)
def _(spark, sf):
    path = fresh_path(spark, "scans")
    kind = F.when(F.col("subject").cast("int") < 10, "sub-").otherwise("other-")
    unit = F.concat_ws(".", F.concat(kind, "subject"), F.concat(F.lit("scan"), "grp"), F.lit("S1"))
    v = fx.event_panel(spark, sf).groupBy(unit.alias("unit"), "t", "node").agg(F.round(F.sum("signal"), 2).alias("signal"))
    reshape.to_wide(v, ["unit", "t"], "node", "signal", NODES).repartition("unit").write.partitionBy("unit").csv(path)
    df = files.scan_file_pattern(spark, path, "sub", ", ".join(["t int", *[f"{n} double" for n in NODES]]))
    return df.unpivot(["subject", "scan", "session", "t"], NODES, "node", "signal")


@query(
    "scan_csv_dim",
    "SELECT s_name AS name, CASE WHEN s_acctbal >= 0 THEN r_name END AS category, s_suppkey AS no, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    path = fresh_path(spark, "dim")
    s, n, r = (fx.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    df = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    df.select(
        F.col("s_name").alias(files.BOM + "name"),
        F.when(F.col("s_acctbal") >= 0, F.col("r_name")).alias("category"),
        F.col("s_suppkey").alias("no"),
        F.when(F.col("s_nationkey") == 3, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
    ).write.option("header", True).option("lineSep", "\r").csv(path)
    from pyspark.sql.types import _parse_datatype_string

    return files.scan_csv_dim(spark, path, _parse_datatype_string("name string, category string, no bigint, balance double"))


@query("scan_matrix_csv", with_(SPI, f"SELECT node_from AS a, node_to AS b, {r6('avg(value)', 'sim')} FROM spi WHERE spi = 'cov' AND node_from < node_to GROUP BY 1, 2"))
def _(spark, sf):
    path = fresh_path(spark, "matrix")
    mean = fx.spi_fact(spark, sf).where("spi = 'cov'").groupBy("node_from", "node_to").agg(F.avg("value").alias("v"))
    reshape.to_wide(mean, ["node_from"], "node_to", "v", NODES).write.option("header", True).csv(path)
    return files.scan_matrix_csv(spark, path, NODES).withColumn("sim", rounded("sim"))


@query("scan_columnar", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


_BY_SPI = f"SELECT spi, count(*) AS n, {r6('sum(value)', 'total', 4)} FROM spi GROUP BY 1"


def _by_spi(df: DataFrame) -> DataFrame:
    return df.groupBy("spi").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("scan_tolerant", with_(SPI, _BY_SPI))
def _(spark, sf):
    path = fresh_path(spark, "results")
    fact = fx.spi_fact(spark, sf)
    fact.write.parquet(f"{path}/good")
    fact.select(F.col("spi").alias("value")).distinct().write.text(f"{path}/broken")  # not a parquet file
    return _by_spi(files.scan_tolerant(spark, path, fact.schema.simpleString()[7:-1].replace(":", " ")))


@query("rejected_files", with_(SPI, "SELECT DISTINCT spi FROM spi"))
def _(spark, sf):
    path = fresh_path(spark, "results")
    fact = fx.spi_fact(spark, sf)
    files.sink_columnar(fact.drop("spi"), f"{path}/good")
    fact.select("spi", F.col("sample_id").alias("value")).repartition("spi").write.partitionBy("spi").text(f"{path}/broken")  # no parquet files
    good = files.scan_tolerant(spark, path, fact.drop("spi").schema.simpleString()[7:-1].replace(":", " "))
    bad = files.rejected_files(spark, path, good)
    return bad.select(F.regexp_extract("file", "spi=([^/]+)/", 1).alias("spi"))


@query("file_faults", with_(SPI, "SELECT DISTINCT spi, true AS told FROM spi"))
def _(spark, sf):
    """Broken result files with the reason."""
    path = fresh_path(spark, "results")
    fact = fx.spi_fact(spark, sf)
    files.sink_columnar(fact.drop("spi"), f"{path}/good")
    fact.select("spi", F.col("sample_id").alias("value")).repartition("spi").write.partitionBy("spi").text(f"{path}/broken")
    return files.file_faults(spark, path).select(F.regexp_extract("file", "spi=([^/]+)/", 1).alias("spi"), (F.length("reason") > 0).alias("told")).distinct()


_DB = with_(EV, "SELECT e.sample_id AS dataset, l.label, e.node, e.t, e.signal AS value FROM ev e LEFT JOIN (SELECT sample_id, unnest(list(DISTINCT node)) AS label FROM ev WHERE signal > 60 GROUP BY 1) l ON l.sample_id = e.sample_id")


@query("scan_mts_database", _DB)
def _(spark, sf):
    path = fresh_path(spark, "datasets")
    p = fx.event_panel(spark, sf)
    labels = p.where("signal > 60").groupBy("sample_id").agg(F.collect_set("node").alias("labels"))
    p.join(labels, "sample_id", "left").select(F.col("sample_id").alias("dataset"), "labels", "node", "t", F.col("signal").alias("value")).write.parquet(path)
    return files.scan_mts_database(spark, path).select("dataset", F.explode_outer("labels").alias("label"), "node", "t", "value")


@query("sink_columnar", with_(SPI, _BY_SPI))
def _(spark, sf):
    path = fresh_path(spark, "fact")
    files.sink_columnar(fx.spi_fact(spark, sf), path, ["spi"])
    return _by_spi(spark.read.parquet(path))


@query("sink_csv", with_(EV, "SELECT sample_id, node, t, signal FROM ev"))
def _(spark, sf):
    path = fresh_path(spark, "csv")
    files.sink_csv(fx.event_panel(spark, sf).select("sample_id", "node", "t", "signal"), path)
    return spark.read.schema("sample_id string, node string, t int, signal double").option("header", True).csv(path)


@query(
    "sink_sample_arrays",
    with_(EV, "SELECT sample_id, node, string_agg(CAST(CAST(round(z * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS vals, count(*) AS n FROM z GROUP BY 1, 2"),
)
def _(spark, sf):
    path = fresh_path(spark, "arrays")
    files.sink_columnar(files.sample_arrays(fx.event_z(spark, sf)), path)
    back = spark.read.schema("sample_id string, node string, values array<double>").parquet(path)
    text = F.transform("values", lambda v: F.round(v * 10000).cast("bigint").cast("string"))
    return back.select("sample_id", "node", F.array_join(text, ",").alias("vals"), F.size("values").cast("bigint").alias("n"))


@query("sample_manifest", with_(EV, "SELECT sample_id, count(DISTINCT node) AS n_nodes, count(DISTINCT t) AS n_t, 'ps' AS dim_order FROM ev GROUP BY 1"))
def _(spark, sf):
    return files.sample_manifest(fx.event_panel(spark, sf))


@query(
    "skip_existing",
    "SELECT DISTINCT o_custkey AS sample_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    requested = o.select(F.col("o_custkey").alias("sample_id")).distinct()
    done = o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("sample_id"))
    return skip_existing(requested, done, ["sample_id"])


# ---- running a list of statistics ------------------------------------------------------------


@query("spi_all")
def _(spark, sf):
    """Every family."""
    return catalog.spi_all(fx.event_z(spark, sf)).withColumn("value", rounded("value"))


@query(
    "spi_config",
    with_(
        PU,
        f", {_MOM}, {_CDS} "
        + melt({"cov_EmpiricalCovariance": "r", "cov_ShrunkCovariance": "0.9 * r", "cov_ShrunkCovariance_shrinkage-0.5": "0.5 * r", "cov-sq_ShrunkCovariance_shrinkage-0.3": "0.49 * r * r"}, "mom")
        + " UNION ALL "
        + melt({"cds": "v"}, "cd"),
    ),
)
def _(spark, sf):
    config = catalog.config_rows(
        spark,
        [
            ("cov_EmpiricalCovariance", "cov", {"estimator": "EmpiricalCovariance", "squared": "false"}),
            ("cov_ShrunkCovariance", "cov_shrunk", {"estimator": "ShrunkCovariance", "squared": "false"}),
            ("cov_ShrunkCovariance_shrinkage-0.5", "cov_shrunk", {"estimator": "ShrunkCovariance", "shrinkage": "0.5", "squared": "false"}),
            ("cov-sq_ShrunkCovariance_shrinkage-0.3", "cov_shrunk", {"estimator": "ShrunkCovariance", "shrinkage": "0.3", "squared": "true"}),
            ("cds", "cds", {}),
        ],
    )
    return catalog.spi_from_config(fx.event_z(spark, sf), config).select("spi", *PAIR, rounded("value").alias("value"))
