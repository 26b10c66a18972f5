"""Reshape, filter, join, aggregate, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairspan import fixtures as fx
from pairspan.functions.numeric import ratio, rounded
from pairspan.functions import scalars as sc
from pairspan.operators import joins, pairs, quality, reshape, sets, stats, windows
from pairspan.workloads.registry import query
from pairspan.workloads.sqltext import EV, PERF, PD, PU, SHIP, SPI, r6, with_

NODES = list(fx.EVENT_NODES)


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in cols})


# ---- reshape ---------------------------------------------------------------------------------


@query("series_to_long", with_(EV, "SELECT sample_id, node, t, signal FROM ev"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    packed = fx.event_panel(spark, sf).groupBy("sample_id", "node").agg(F.array_sort(F.collect_list(F.struct("t", "signal"))).alias("s"))
    return reshape.series_to_long(packed.select("sample_id", "node", F.col("s.signal").alias("values")))


@query(
    "regions_to_long",
    with_(EV, "SELECT sample_id, t, node AS region, signal FROM ev"),
)
def _(spark, sf):
    wide = reshape.to_wide(fx.event_panel(spark, sf), ["sample_id", "t"], "node", "signal", NODES)
    return reshape.columns_to_long(wide, ["sample_id", "t"], NODES, "region", "signal")


@query(
    "series_to_wide",
    with_(
        EV,
        "SELECT sample_id, node, "
        + ", ".join(r6(f"max(CASE WHEN t = {i} THEN z END)", f"t{i}") for i in range(30))
        + " FROM z GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    wide = reshape.to_wide(fx.event_z(spark, sf), ["sample_id", "node"], "t", "z", list(range(30)))
    return wide.select("sample_id", "node", *[rounded(F.col(str(i))).alias(f"t{i}") for i in range(30)])


@query(
    "spi_matrix",
    with_(
        SPI,
        "SELECT spi, sample_id, node_from, "
        + ", ".join(r6(f"max(CASE WHEN node_to = '{n}' THEN value END)", f"to_{n}") for n in NODES)
        + " FROM spi GROUP BY 1, 2, 3",
    ),
)
def _(spark, sf):
    m = reshape.spi_matrix(fx.spi_fact(spark, sf), NODES)
    return m.select("spi", "sample_id", "node_from", *[rounded(n).alias(f"to_{n}") for n in NODES])


@query("matrix_to_pairs", with_(SPI, f"SELECT spi, sample_id, node_from, node_to, {r6('value', 'value')} FROM spi WHERE value IS NOT NULL"))
def _(spark, sf):
    m = reshape.spi_matrix(fx.spi_fact(spark, sf), NODES)
    return _r(reshape.matrix_to_pairs(m, NODES), "value")


_PAIRS = [(a, b) for a in NODES for b in NODES if a != b]


@query(
    "feature_matrix_pairs",
    with_(
        SPI,
        "SELECT spi, sample_id, grp, "
        + ", ".join(r6(f"max(CASE WHEN node_from = '{a}' AND node_to = '{b}' THEN value END)", f"{a}_{b}") for a, b in _PAIRS)
        + " FROM spi JOIN spi_info USING (spi) WHERE node_from <> node_to AND (directionality = 'Directed' OR node_from < node_to) GROUP BY 1, 2, 3",
    ),
)
def _(spark, sf):
    fact = quality.direction_switch(fx.spi_fact(spark, sf), fx.spi_info(spark)).withColumn("node_pair", reshape.node_pair())
    fact = joins.join_sample_metadata(fact, fx.event_samples(spark, sf))
    cols = [f"{a}_{b}" for a, b in _PAIRS]
    wide = reshape.to_wide(fact, ["spi", "sample_id", "grp"], "node_pair", "value", cols)
    return _r(wide, *cols)


# a cell that a sample lacks is 0 in its column; a value that is NULL stays NULL and is left out of the text
_VECTOR_SQL = """, f AS (SELECT DISTINCT sample_id, grp, subject, concat_ws('_', node_from, node_to, spi) AS feature, value FROM spi
  WHERE node_from < node_to OR (spi = 'lag1' AND node_from <> node_to)),
k AS (SELECT DISTINCT {keys} FROM f), n AS (SELECT DISTINCT feature FROM f)
SELECT {keys}, string_agg(feature, ',' ORDER BY feature) AS features, string_agg(cell, ',' ORDER BY feature) AS vector
FROM (SELECT k.*, n.feature, CASE WHEN f.feature IS NULL THEN '0' ELSE CAST(CAST(round(f.value * 10000) AS BIGINT) AS VARCHAR) END AS cell
  FROM k CROSS JOIN n LEFT JOIN f ON f.sample_id = k.sample_id AND f.feature = n.feature) g GROUP BY {keys}"""


def _vectors(spark, sf, keys):
    fact = fx.spi_fact(spark, sf).where("node_from < node_to OR (spi = 'lag1' AND node_from <> node_to)")
    long = fact.select("sample_id", F.concat_ws("_", "node_from", "node_to", "spi").alias("feature"), "value").dropDuplicates()
    long = joins.join_sample_metadata(long, fx.event_samples(spark, sf))
    v = reshape.feature_vectors(long, keys)
    micro = F.transform("vector", lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return v.select(*keys, F.array_join("features", ",").alias("features"), F.array_join(micro, ",").alias("vector"))


@query("feature_matrix_all", with_(SPI, _VECTOR_SQL.format(keys="sample_id, grp")))
def _(spark, sf):
    return _vectors(spark, sf, ["sample_id", "grp"])


@query("feature_matrix_by_subject", with_(SPI, _VECTOR_SQL.format(keys="sample_id, subject, grp")))
def _(spark, sf):
    return _vectors(spark, sf, ["sample_id", "subject", "grp"])


@query(
    "transpose_matrix",
    with_(
        EV,
        "SELECT node, " + ", ".join(r6(f"sum(CASE WHEN t = {i} THEN signal END)", f"day_{i}", 2) for i in range(30)) + " FROM ev GROUP BY 1",
    ),
)
def _(spark, sf):
    totals = fx.event_panel(spark, sf).groupBy("t", "node").agg(F.sum("signal").alias("s"))
    wide = reshape.to_wide(totals, ["t"], "node", "s", NODES)
    flat = reshape.transpose_matrix(wide, "t", NODES, "node", list(range(30)))
    return flat.select("node", *[rounded(F.col(str(i)), 2).alias(f"day_{i}") for i in range(30)])


@query(
    "make_keys",
    """SELECT DISTINCT concat_ws('_', 'Train', user_id) AS sample_id, concat_ws('_', user_id, event_type, 'S1') AS unique_id,
              concat_ws('_', concat_ws('_', event_type, 'view'), 'cov') AS feature FROM events""",
)
def _(spark, sf):
    return (
        fx.table(spark, sf, "events")
        .select(
            F.concat_ws("_", F.lit("Train"), "user_id").alias("sample_id"),
            F.concat_ws("_", "user_id", "event_type", F.lit("S1")).alias("unique_id"),
            F.concat_ws("_", F.concat_ws("_", "event_type", F.lit("view")), F.lit("cov")).alias("feature"),
        )
        .distinct()
    )


@query(
    "split_keys",
    """SELECT split_part(k, '.', 1) AS subject, split_part(k, '.', 2) AS scan, split_part(k, '.', 3) AS session,
              split_part(p, '__', 1) AS class_a, split_part(p, '__', 2) AS class_b, count(*) AS n
       FROM (SELECT concat_ws('.', c_custkey, c_mktsegment, c_nationkey, 'csv') AS k, concat(c_mktsegment, '__', c_nationkey) AS p
             FROM customer) GROUP BY ALL""",
)
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.concat_ws(".", "c_custkey", "c_mktsegment", "c_nationkey", F.lit("csv")).alias("k"),
        F.concat("c_mktsegment", F.lit("__"), "c_nationkey").alias("p"),
    )
    return sc.split_pair(sc.split_file_name(c, "k"), "p").groupBy("subject", "scan", "session", "class_a", "class_b").agg(F.count("*").alias("n"))


@query(
    "rename_drop_add",
    "SELECT DISTINCT c_custkey AS sample_id, c_mktsegment AS grp, 'Train' AS split, 'customers' AS problem, 'All' AS spi FROM customer",
)
def _(spark, sf):
    return (
        fx.table(spark, sf, "customer")
        .withColumnsRenamed({"c_custkey": "sample_id", "c_mktsegment": "grp"})
        .drop("c_name", "c_nationkey", "c_acctbal")
        .withColumns({"split": F.lit("Train"), "problem": F.lit("customers"), "spi": F.lit("All")})
    )


@query("percent_scale", with_(PERF, f"SELECT problem, spi, {r6('100 * mean_accuracy', 'accuracy_pct', 7)} FROM means"))
def _(spark, sf):
    m = stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem", "spi"])
    return m.select("problem", "spi", rounded(100 * F.col("mean_accuracy"), 7).alias("accuracy_pct"))


@query(
    "significance_label",
    with_(PERF, "SELECT problem, spi, CASE WHEN p_bonferroni < 0.05 THEN 'Significant SPIs' ELSE 'Not Sig' END AS label FROM pvals"),
)
def _(spark, sf):
    p = stats.p_values(*fx.accuracy_tables(spark, sf), ["problem"])
    return p.select("problem", "spi", sc.significance_label(F.col("significant")).alias("label"))


# ---- filters ---------------------------------------------------------------------------------

_FACT = f"SELECT spi, sample_id, node_from, node_to, {r6('value', 'value')} FROM spi"


def _fact(spark, sf):
    return fx.spi_fact(spark, sf)


@query("drop_self_pairs", with_(SPI, _FACT + " WHERE node_from <> node_to"))
def _(spark, sf):
    return _r(quality.drop_self_pairs(_fact(spark, sf)), "value")


@query("upper_triangle", with_(SPI, _FACT + " WHERE node_from < node_to"))
def _(spark, sf):
    return _r(quality.upper_triangle(_fact(spark, sf)), "value")


@query(
    "direction_switch",
    with_(
        SPI,
        f"SELECT s.spi, directionality, sample_id, node_from, node_to, {r6('value', 'value')} FROM spi s JOIN spi_info i ON s.spi = i.spi "
        "WHERE node_from <> node_to AND (directionality = 'Directed' OR node_from < node_to)",
    ),
)
def _(spark, sf):
    return _r(quality.direction_switch(_fact(spark, sf), fx.spi_info(spark)), "value")


@query("spi_in_list", with_(SPI, _FACT + " WHERE spi IN (SELECT spi FROM spi_info)"))
def _(spark, sf):
    return _r(quality.spi_in_list(_fact(spark, sf), fx.spi_info(spark)), "value")


@query("keep_complete_frames", with_(SHIP, "SELECT sample_id, node, t, signal FROM mts WHERE t < 72"))
def _(spark, sf):
    return fx.ship_panel(spark, sf).where(F.col("t") < 72).select("sample_id", "node", "t", "signal")


_LISTED = "SELECT * FROM spi WHERE spi IN (SELECT spi FROM spi_info)"


def _listed(spark, sf):
    return quality.spi_in_list(_fact(spark, sf), fx.spi_info(spark))


_QC_CONST = f"SELECT spi FROM ({_LISTED}) GROUP BY 1 HAVING count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 1"
_QC_ALL = f"SELECT spi FROM ({_LISTED}) GROUP BY 1 HAVING count(DISTINCT {{k}}) = (SELECT count(DISTINCT {{k}}) FROM ({_LISTED}))"


@query("qc_nonconstant", with_(SPI, _QC_CONST))
def _(spark, sf):
    return quality.qc_nonconstant(_listed(spark, sf))


@query("qc_complete", with_(SPI, _QC_ALL.format(k="sample_id")))
def _(spark, sf):
    return quality.qc_complete(_listed(spark, sf))


@query("qc_complete_by_subject", with_(SPI, _QC_ALL.format(k="subject")))
def _(spark, sf):
    fact = joins.join_sample_metadata(_listed(spark, sf), fx.event_samples(spark, sf))
    return quality.qc_complete(fact, "subject")


_QC_KEEP = f""", listed AS MATERIALIZED ({_LISTED}), good AS (SELECT spi FROM listed GROUP BY 1
  HAVING count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 1 AND count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM listed))
{_FACT.replace(' FROM spi', ' FROM listed')} WHERE spi IN (SELECT spi FROM good)"""


@query("qc_keep", with_(SPI, _QC_KEEP))
def _(spark, sf):
    return _r(quality.qc_keep(_listed(spark, sf)), "value")


@query("qc_keep_by_subject", with_(SPI, _QC_KEEP.replace("DISTINCT sample_id", "DISTINCT subject")))
def _(spark, sf):
    fact = joins.join_sample_metadata(_listed(spark, sf), fx.event_samples(spark, sf))
    return _r(quality.qc_keep(fact, "subject"), "value").select("spi", "sample_id", "node_from", "node_to", "value")


@query(
    "group_in",
    with_(SPI, f"SELECT sample_id, grp, {r6('value', 'value')} FROM spi WHERE spi = 'cov' AND grp IN ('1', '3') AND node_from = 'click' AND node_to = 'view'"),
)
def _(spark, sf):
    z = fx.event_z(spark, sf).where(F.col("grp").isin("1", "3") & F.col("node").isin("click", "view"))
    meta = fx.event_samples(spark, sf).where(F.col("grp").isin("1", "3"))
    cov = pairs.pair_self_join(z).groupBy(*pairs.PAIR).agg(F.avg(F.col("x") * F.col("y")).alias("value"))
    one = cov.where("node_from = 'click' AND node_to = 'view'")
    return joins.join_sample_metadata(one, meta).select("sample_id", "grp", rounded("value").alias("value"))


@query("not_missing_dim", with_(PERF, "SELECT spi, category FROM dim WHERE category IS NOT NULL"))
def _(spark, sf):
    return fx.supplier_dim(spark, sf).where(F.col("category").isNotNull()).select("spi", "category")


_COLOURS = """(SELECT r_name AS module, 'Literature' AS module_type, printf('#%06x', 1000000 + r_regionkey) AS colour FROM region
 UNION ALL SELECT n_name, 'HClust', printf('#%06x', 2000000 + n_nationkey) FROM nation)"""


def _colours(spark, sf):
    r = fx.table(spark, sf, "region").select(
        F.col("r_name").alias("module"), F.lit("Literature").alias("module_type"), F.format_string("#%06x", 1000000 + F.col("r_regionkey")).alias("colour")
    )
    n = fx.table(spark, sf, "nation").select(
        F.col("n_name").alias("module"), F.lit("HClust").alias("module_type"), F.format_string("#%06x", 2000000 + F.col("n_nationkey")).alias("colour")
    )
    return r.unionByName(n)


@query(
    "dim_type_filter",
    with_(PERF, f"SELECT spi, d.module, colour FROM dim d LEFT JOIN (SELECT * FROM {_COLOURS} WHERE module_type = 'HClust') c ON d.module = c.module"),
)
def _(spark, sf):
    hclust = _colours(spark, sf).where("module_type = 'HClust'").select("module", "colour")
    return fx.supplier_dim(spark, sf).join(hclust, "module", "left").select("spi", "module", "colour")


# ---- joins -----------------------------------------------------------------------------------

_PROC = "(SELECT concat('proc-', row_number() OVER (ORDER BY node) - 1) AS proc, node FROM (SELECT DISTINCT event_type AS node FROM events WHERE event_type <> 'view'))"


def _lookup(spark, sf):
    """Channel codes; one channel has no name, so the left joins keep a NULL."""
    nodes = fx.table(spark, sf, "events").where("event_type <> 'view'").select(F.col("event_type").alias("node")).distinct()
    no = F.row_number().over(Window.orderBy("node")) - 1  # a handful of channel names
    return nodes.select(F.concat(F.lit("proc-"), no).alias("proc"), "node")


def _coded(col: str):
    return F.concat(F.lit("proc-"), F.array_position(F.array(*[F.lit(n) for n in NODES]), F.col(col)) - 1)


_CODE_SQL = "concat('proc-', list_position(['click', 'error', 'purchase', 'signup', 'view'], {c}) - 1)"


@query(
    "join_node_lookup",
    with_(EV, f"SELECT sample_id, t, signal, l.node FROM ev e LEFT JOIN {_PROC} l ON {_CODE_SQL.format(c='e.node')} = l.proc"),
)
def _(spark, sf):
    coded = fx.event_panel(spark, sf).select("sample_id", "t", "signal", _coded("node").alias("proc"))
    return joins.join_node_lookup(coded, _lookup(spark, sf))


@query(
    "join_node_lookup_twice",
    with_(
        SPI,
        f"""SELECT s.spi, s.sample_id, a.node AS node_from, b.node AS node_to, {r6('value', 'value')} FROM spi s
        LEFT JOIN {_PROC} a ON {_CODE_SQL.format(c='s.node_from')} = a.proc LEFT JOIN {_PROC} b ON {_CODE_SQL.format(c='s.node_to')} = b.proc
        WHERE s.node_from <> s.node_to""",
    ),
)
def _(spark, sf):
    coded = quality.drop_self_pairs(_fact(spark, sf)).select(
        "spi", "sample_id", "value", _coded("node_from").alias("proc_from"), _coded("node_to").alias("proc_to")
    )
    return _r(joins.join_node_lookup_twice(coded, _lookup(spark, sf)), "value")


_REGIONS = "(SELECT n_name AS region, r_name AS network FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4)"
_BOLD = """(SELECT n_name AS region, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) AS signal
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def _bold(spark, sf):
    o, c, n = (fx.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("region"), month.alias("t"))
        .agg(F.sum("o_totalprice").alias("signal"))
    )


def _networks(spark, sf):
    n, r = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region").where("r_regionkey <> 4")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("region"), F.col("r_name").alias("network"))


@query("join_region_network", f"SELECT b.region, t, network, {r6('signal', 'signal', 2)} FROM {_BOLD} b LEFT JOIN {_REGIONS} r ON b.region = r.region")
def _(spark, sf):
    return _r(joins.join_region_network(_bold(spark, sf), _networks(spark, sf)), "signal", digits=2)


@query(
    "network_mean",
    f"SELECT network, t, {r6('avg(signal)', 'signal', 3)} FROM {_BOLD} b LEFT JOIN {_REGIONS} r ON b.region = r.region GROUP BY 1, 2",
)
def _(spark, sf):
    joined = joins.join_region_network(_bold(spark, sf), _networks(spark, sf))
    return _r(joins.network_mean(joined, ["network", "t"]), "signal", digits=3)


@query("join_sample_metadata", with_(SPI, f"SELECT spi, sample_id, node_from, node_to, grp, subject, {r6('value', 'value')} FROM spi"))
def _(spark, sf):
    return _r(joins.join_sample_metadata(_fact(spark, sf), fx.event_samples(spark, sf)), "value")


@query("semi_join_metadata", with_(SPI, "SELECT * FROM meta WHERE sample_id IN (SELECT sample_id FROM spi WHERE spi = 'significant' AND value > 0.7)"))
def _(spark, sf):
    strong = _fact(spark, sf).where("spi = 'significant' AND value > 0.7")
    return joins.semi_join_metadata(fx.event_samples(spark, sf), strong)


@query(
    "join_spi_info",
    with_(SPI, f"SELECT s.spi, sample_id, node_from, node_to, {r6('value', 'value')}, directionality, category, module FROM spi s LEFT JOIN spi_info i ON s.spi = i.spi"),
)
def _(spark, sf):
    return _r(joins.join_spi_info(_fact(spark, sf), fx.spi_info(spark)), "value")


@query(
    "join_colours_diff_keys",
    with_(PERF, f"SELECT spi, category, d.module, colour FROM dim d LEFT JOIN (SELECT * FROM {_COLOURS} WHERE module_type = 'Literature') c ON d.category = c.module"),
)
def _(spark, sf):
    lit = _colours(spark, sf).where("module_type = 'Literature'").select("module", "colour")
    df = fx.supplier_dim(spark, sf).withColumnRenamed("module", "own_module")
    return joins.join_colours(df, lit).withColumnRenamed("own_module", "module")


@query(
    "anti_dropped_spis",
    with_(SPI, f"SELECT spi FROM spi_info WHERE spi NOT IN ({_QC_CONST} INTERSECT {_QC_ALL.format(k='sample_id')})"),
)
def _(spark, sf):
    return quality.dropped_spis(fx.spi_info(spark), quality.qc_keep(_listed(spark, sf)))


@query("pair_self_join", with_(PU, f"SELECT sample_id, node_from, node_to, t, {r6('x', 'x')}, {r6('y', 'y')} FROM pu"))
def _(spark, sf):
    return _r(pairs.pair_self_join(fx.event_z(spark, sf)), "x", "y")


@query(
    "lag_self_join",
    with_(
        EV,
        f"""SELECT a.sample_id, a.node AS node_from, b.node AS node_to, l.lag, count(*) AS n, {r6('avg(a.z * b.z)', 'value')}
        FROM z a CROSS JOIN (VALUES (-2), (1), (5)) l(lag) JOIN z b ON a.sample_id = b.sample_id AND b.t = a.t + l.lag AND a.node <> b.node
        GROUP BY 1, 2, 3, 4""",
    ),
)
def _(spark, sf):
    pts = pairs.lag_self_join(fx.event_z(spark, sf), [-2, 1, 5])
    out = pts.groupBy(*pairs.PAIR, "lag").agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("y")).alias("value"))
    return _r(out, "value")


# ---- aggregates ------------------------------------------------------------------------------


@query("accuracy_by_spi", with_(PERF, f"SELECT problem, spi, {r6('mean_accuracy', 'mean_accuracy', 9)}, {r6('sd_accuracy', 'sd_accuracy', 9)} FROM means"))
def _(spark, sf):
    m = stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem", "spi"])
    return _r(m, "mean_accuracy", "sd_accuracy", digits=9)


@query("accuracy_overall", with_(PERF, f"SELECT problem, {r6('avg(accuracy)', 'mean_accuracy')}, {r6('stddev_samp(accuracy)', 'sd_accuracy')} FROM acc GROUP BY 1"))
def _(spark, sf):
    return _r(stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem"]), "mean_accuracy", "sd_accuracy")


@query("distinct_metadata", with_(EV, "SELECT * FROM meta"))
def _(spark, sf):
    return fx.event_samples(spark, sf)


@query(
    "distinct_values",
    with_(SPI, "SELECT DISTINCT node_from AS name, 'node' AS kind FROM spi UNION SELECT node_to, 'node' FROM spi UNION SELECT spi, 'spi' FROM spi UNION SELECT grp, 'grp' FROM spi"),
)
def _(spark, sf):
    fact = joins.join_sample_metadata(_fact(spark, sf), fx.event_samples(spark, sf))
    return sets.distinct_names(fact, {"node_from": "node", "node_to": "node", "spi": "spi", "grp": "grp"})


@query("drop_duplicates", "SELECT DISTINCT user_id, event_type, day(ts) AS d FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("d")).dropDuplicates()


@query(
    "histogram_share",
    with_(
        PERF,
        f"""SELECT problem, p_bonferroni < 0.05 AS significant, CAST(least(floor((mean_accuracy - 0.0) / (1.0 / 28)), 27) AS BIGINT) AS bin, count(*) AS n,
        {r6('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY problem)', 'share')}
        FROM pvals WHERE mean_accuracy BETWEEN 0 AND 1 GROUP BY 1, 2, 3""",
    ),
)
def _(spark, sf):
    p = stats.p_values(*fx.accuracy_tables(spark, sf), ["problem"])
    return _r(stats.histogram_share(p, ["problem"], 28, 0.0, 1.0), "share")


_BOX = (
    "count({v}) AS n, " + r6("avg({v})", "mean") + ", " + r6("min({v})", "low") + ", " + r6("quantile_cont({v}, 0.25)", "q1") + ", "
    + r6("quantile_cont({v}, 0.5)", "median") + ", " + r6("quantile_cont({v}, 0.75)", "q3") + ", " + r6("max({v})", "high")
)
_BOX_COLS = ["mean", "low", "q1", "median", "q3", "high"]


@query("category_summary", with_(PERF, f"SELECT category, {_BOX.format(v='mean_accuracy')} FROM means m JOIN dim d ON m.spi = d.spi WHERE category IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    m = stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem", "spi"])
    joined = m.join(fx.supplier_dim(spark, sf), "spi").where(F.col("category").isNotNull())
    return _r(stats.box_summary(joined, ["category"], "mean_accuracy").drop("fence_low", "fence_high"), *_BOX_COLS)


@query("module_summary", with_(PERF, f"SELECT module, {_BOX.format(v='mean_accuracy')} FROM means m JOIN dim d ON m.spi = d.spi GROUP BY 1"))
def _(spark, sf):
    m = stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem", "spi"])
    joined = m.join(fx.supplier_dim(spark, sf), "spi")
    return _r(stats.box_summary(joined, ["module"], "mean_accuracy").drop("fence_low", "fence_high"), *_BOX_COLS)


@query(
    "group_distribution",
    with_(
        SPI,
        f"""SELECT b.*, {r6('min(v.value)', 'whisker_low')}, {r6('max(v.value)', 'whisker_high')} FROM
        (SELECT grp, {_BOX.format(v='value')} FROM spi WHERE spi = 'cov' AND node_from = 'click' AND node_to = 'view' GROUP BY 1) b
        JOIN spi v ON v.spi = 'cov' AND v.node_from = 'click' AND v.node_to = 'view' AND v.grp = b.grp
         AND v.value BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    fact = _fact(spark, sf).where("spi = 'cov' AND node_from = 'click' AND node_to = 'view'")
    fact = joins.join_sample_metadata(fact, fx.event_samples(spark, sf))
    w = stats.whiskers(fact, ["grp"], "value").drop("fence_low", "fence_high")
    return _r(w, *_BOX_COLS, "whisker_low", "whisker_high")


@query(
    "pooled_null",
    with_(
        PERF,
        f"""SELECT problem, {r6('null_accuracy', 'null_accuracy', 9)}, n, CAST(sum(n) OVER (PARTITION BY problem ORDER BY null_accuracy) - n AS BIGINT) AS n_below,
        CAST(sum(n) OVER (PARTITION BY problem) AS BIGINT) AS n_pool FROM (SELECT problem, null_accuracy, count(*) AS n FROM pooled GROUP BY 1, 2)""",
    ),
)
def _(spark, sf):
    return _r(stats.pooled_null(fx.accuracy_tables(spark, sf)[1], ["problem"]), "null_accuracy", digits=9)


# ---- windows, sorts --------------------------------------------------------------------------


@query(
    "row_number_id",
    "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS id FROM orders",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return windows.row_number_id(o, "o_custkey", "o_orderkey")


@query("row_number_time", with_(EV, "SELECT sample_id, node, t, CAST(row_number() OVER (PARTITION BY grp, sample_id, node ORDER BY t) AS INTEGER) AS timepoint_num FROM ev"))
def _(spark, sf):
    return windows.row_number_time(fx.event_panel(spark, sf), ["grp", "sample_id", "node"]).select("sample_id", "node", "t", "timepoint_num")


@query("zscore_series", with_(EV, f"SELECT sample_id, node, t, {r6('z', 'z')} FROM z"))
def _(spark, sf):
    return _r(fx.event_z(spark, sf).select("sample_id", "node", "t", "z"), "z")


@query("limit_datasets", "SELECT DISTINCT event_type AS dataset FROM events ORDER BY 1 LIMIT 3")
def _(spark, sf):
    return sets.first_names(fx.table(spark, sf, "events").select(F.col("event_type").alias("dataset")), "dataset", 3)


_WELCH = """m AS (SELECT spi, node_from, node_to, grp, avg(value) AS mean, var_samp(value) AS var, count(value) AS n FROM spi WHERE node_from <> node_to GROUP BY 1, 2, 3, 4),
wt AS (SELECT a.spi, a.node_from, a.node_to, a.grp AS grp_a, b.grp AS grp_b,
  CASE WHEN sqrt(a.var / a.n + b.var / b.n) > 1e-12 THEN (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) END AS t_stat
  FROM m a JOIN m b ON a.spi = b.spi AND a.node_from = b.node_from AND a.node_to = b.node_to AND a.grp < b.grp),
top AS (SELECT spi, node_from, node_to, grp_a, grp_b, t_stat FROM (SELECT *, row_number() OVER (PARTITION BY spi
  ORDER BY round(-abs(t_stat), 9), grp_a, grp_b, node_from, node_to) AS rk FROM wt WHERE t_stat IS NOT NULL) WHERE rk = 1)"""


def _with_grp(spark, sf):
    return joins.join_sample_metadata(_fact(spark, sf), fx.event_samples(spark, sf))


@query("welch_t", with_(SPI, f", {_WELCH} SELECT spi, node_from, node_to, grp_a, grp_b, {r6('t_stat', 't_stat')} FROM wt"))
def _(spark, sf):
    return _r(stats.welch_t(quality.drop_self_pairs(_with_grp(spark, sf)), ["spi", "node_from", "node_to"]), "t_stat")


@query("top_abs_pair", with_(SPI, f", {_WELCH} SELECT spi, node_from, node_to, grp_a, grp_b, {r6('t_stat', 't_stat')} FROM top"))
def _(spark, sf):
    t = stats.welch_t(quality.drop_self_pairs(_with_grp(spark, sf)), ["spi", "node_from", "node_to"])
    return _r(stats.top_abs(t, ["spi"], "t_stat", ["grp_a", "grp_b", "node_from", "node_to"]), "t_stat")


@query(
    "most_discriminative_pair",
    with_(
        SPI,
        f""", {_WELCH} SELECT s.spi, s.sample_id, s.grp, s.node_from, s.node_to, {r6('value', 'value')}, {r6('t_stat', 't_stat')} FROM spi s
        JOIN top t ON s.spi = t.spi AND s.node_from = t.node_from AND s.node_to = t.node_to AND s.grp IN (t.grp_a, t.grp_b)""",
    ),
)
def _(spark, sf):
    return _r(stats.most_discriminative_pair(_with_grp(spark, sf)).drop("subject"), "value", "t_stat")


@query(
    "fig_violin_table",
    with_(
        SPI,
        f""", {_WELCH} SELECT 'events' AS problem, s.grp, s.sample_id, s.spi, s.node_from, s.node_to, {r6('value', 'value')} FROM spi s
        JOIN top t ON s.spi = t.spi AND s.node_from = t.node_from AND s.node_to = t.node_to AND s.grp IN (t.grp_a, t.grp_b) WHERE s.spi IN ('cov', 'lag1')""",
    ),
)
def _(spark, sf):
    from pairspan.plans.tables import violin_table

    fact = _with_grp(spark, sf)
    return _r(violin_table({"cov": ("events", fact), "lag1": ("events", fact)}), "value")


@query(
    "spis_beating",
    with_(PERF, f"SELECT problem, spi, {r6('mean_accuracy', 'mean_accuracy', 9)} FROM means m WHERE mean_accuracy > (SELECT mean_accuracy FROM means x WHERE x.spi = 'S7' AND x.problem = m.problem) ORDER BY 3 DESC"),
)
def _(spark, sf):
    m = stats.accuracy_summary(fx.accuracy_tables(spark, sf)[0], ["problem", "spi"])
    return _r(sets.beating(m, "S7", ["problem"]).select("problem", "spi", "mean_accuracy"), "mean_accuracy", digits=9)


@query(
    "first_seen_order",
    "SELECT event_type, first_pos, CAST(row_number() OVER (ORDER BY first_pos) AS INTEGER) AS rank FROM (SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1)",
)
def _(spark, sf):
    return sets.first_seen(fx.table(spark, sf, "events"), "event_type", "event_id")


# ---- sets ------------------------------------------------------------------------------------


@query("union_by_name", "SELECT c_custkey AS id, c_mktsegment AS activity, CAST(NULL AS VARCHAR) AS cortical FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def _(spark, sf):
    a = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("activity"))
    b = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("cortical"))
    return a.unionByName(b, allowMissingColumns=True)


@query("union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionAll(fx.table(spark, sf, "supplier").select("s_nationkey"))


@query("intersect_keys", with_(SPI, f"{_QC_CONST} INTERSECT {_QC_ALL.format(k='sample_id')}"))
def _(spark, sf):
    return quality.qc_nonconstant(_listed(spark, sf)).intersect(quality.qc_complete(_listed(spark, sf)))


@query("except_keys", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 45")
def _(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(
        fx.table(spark, sf, "lineitem").where("l_quantity >= 45").select("l_partkey")
    )


@query(
    "combinations_2",
    with_(EV, "SELECT 'class' AS kind, a.grp AS a, b.grp AS b FROM (SELECT DISTINCT grp FROM ev) a JOIN (SELECT DISTINCT grp FROM ev) b ON a.grp < b.grp UNION ALL SELECT 'node', a.node, b.node FROM (SELECT DISTINCT node FROM ev) a JOIN (SELECT DISTINCT node FROM ev) b ON a.node <> b.node"),
)
def _(spark, sf):
    panel = fx.event_panel(spark, sf)
    classes = sets.combinations(panel, "grp", ordered=False).select(F.lit("class").alias("kind"), "a", "b")
    return classes.unionAll(sets.combinations(panel, "node", ordered=True).select(F.lit("node"), "a", "b"))


# ---- scalars ---------------------------------------------------------------------------------


@query(
    "scalar_string",
    """SELECT c_custkey, concat('M', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS module, concat_ws('_', c_mktsegment, c_nationkey) AS key,
              split_part(c_name, '#', 1) AS stem FROM customer""",
)
def _(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey",
        sc.module_label(F.col("c_nationkey")).alias("module"),
        F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("key"),
        F.split("c_name", "#")[0].alias("stem"),
    )


@query(
    "scalar_math",
    f"SELECT c_custkey, {r6('abs(c_acctbal)', 'a', 4)}, {r6('c_acctbal * c_acctbal', 'sq', 4)}, {r6('1 - c_acctbal', 'one_minus', 4)}, {r6('sqrt(abs(c_acctbal))', 'root', 4)}, {r6('greatest(c_acctbal, 0)', 'pos', 4)}, {r6('least(c_acctbal, 0)', 'neg', 4)} FROM customer",
)
def _(spark, sf):
    b = F.col("c_acctbal")
    zero = F.lit(0.0)
    cols = {"a": F.abs(b), "sq": F.pow(b, 2), "one_minus": 1 - b, "root": F.sqrt(F.abs(b)), "pos": F.greatest(b, zero), "neg": F.least(b, zero)}
    return fx.table(spark, sf, "customer").select("c_custkey", *[rounded(c, 4).alias(n) for n, c in cols.items()])


@query(
    "scalar_missing",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 WHEN s_nationkey = 3 THEN 1.7976931348623157e308 WHEN s_nationkey = 5 THEN -1.7976931348623157e308 ELSE s_acctbal END AS filled FROM supplier""",
)
def _(spark, sf):
    raw = (
        F.when(F.col("s_acctbal") < 0, F.lit(float("nan")))
        .when(F.col("s_nationkey") == 3, F.lit(float("inf")))
        .when(F.col("s_nationkey") == 5, F.lit(float("-inf")))
        .otherwise(F.col("s_acctbal"))
    )
    return fx.table(spark, sf, "supplier").select("s_suppkey", reshape.missing_to_number(raw).alias("filled"))


@query(
    "scalar_band",
    "SELECT event_id, CAST(CASE WHEN value >= 75 THEN 2.0 WHEN value >= 50 THEN 0.75 WHEN value >= 25 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS weight FROM events",
)
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", sc.band_weight(F.col("value"), (75.0, 50.0, 25.0)).alias("weight"))


@query(
    "scalar_colour",
    "SELECT p_partkey, printf('#%02x%02x%02x', CAST(p_partkey % 256 AS INTEGER), CAST(p_size AS INTEGER), CAST((p_partkey * 7) % 256 AS INTEGER)) AS colour FROM part",
)
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", sc.hex_colour(F.col("p_partkey") % 256, F.col("p_size"), (F.col("p_partkey") * 7) % 256).alias("colour"))


@query(
    "default_fill",
    with_(PERF, f"SELECT spi, coalesce(colour, '#000000') AS colour FROM dim d LEFT JOIN (SELECT * FROM {_COLOURS} WHERE module_type = 'Literature') c ON d.category = c.module"),
)
def _(spark, sf):
    lit = _colours(spark, sf).where("module_type = 'Literature'").select("module", "colour")
    df = joins.join_colours(fx.supplier_dim(spark, sf).select("spi", "category"), lit)
    return df.select("spi", F.coalesce("colour", F.lit("#000000")).alias("colour"))


@query(
    "array_labels",
    """SELECT l.label, count(*) AS n, CAST(sum(CASE WHEN list_contains(labels, 'view') THEN 1 ELSE 0 END) AS BIGINT) AS with_view
       FROM (SELECT user_id, list(DISTINCT event_type) AS labels FROM events WHERE value > 20 GROUP BY 1) d, unnest(d.labels) l(label) GROUP BY 1""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "events").where("value > 20").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    return d.select(F.explode("labels").alias("label"), "labels").groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.array_contains("labels", "view").cast("bigint")).alias("with_view")
    )


# ---- significance ----------------------------------------------------------------------------


@query("p_empirical", with_(PERF, f"SELECT problem, spi, {r6('mean_accuracy', 'mean_accuracy', 9)}, {r6('p_value', 'p_value')} FROM pv"))
def _(spark, sf):
    acc, nul = fx.accuracy_tables(spark, sf)
    means = stats.accuracy_summary(acc, ["problem", "spi"]).drop("sd_accuracy")
    return _r(_r(stats.p_empirical(means, nul, ["problem"]), "mean_accuracy", digits=9), "p_value")


@query("p_bonferroni", with_(PERF, f"SELECT problem, spi, {r6('p_value', 'p_value')}, {r6('p_bonferroni', 'p_bonferroni')} FROM pvals"))
def _(spark, sf):
    p = stats.p_values(*fx.accuracy_tables(spark, sf), ["problem"])
    return _r(p.select("problem", "spi", "p_value", "p_bonferroni"), "p_value", "p_bonferroni")


@query("p_significant", with_(PERF, "SELECT problem, spi, p_bonferroni < 0.05 AS significant FROM pvals"))
def _(spark, sf):
    return stats.p_values(*fx.accuracy_tables(spark, sf), ["problem"]).select("problem", "spi", "significant")


@query(
    "fig_hist_table",
    with_(
        PERF,
        f""", om AS (SELECT problem, round(avg(accuracy), 9) AS mean_accuracy FROM acc GROUP BY 1),
        op AS (SELECT problem, mean_accuracy, 1 - (SELECT count(*) FROM pooled p WHERE p.problem = om.problem AND om.mean_accuracy > p.null_accuracy)::DOUBLE
          / (SELECT count(*) FROM pooled p WHERE p.problem = om.problem) AS p FROM om)
        SELECT problem, 'All' AS spi, {r6('100 * mean_accuracy', 'accuracy_pct', 7)}, {r6('least(1.0, p)', 'p_bonferroni')}, p < 0.05 AS significant, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS module FROM op
        UNION ALL SELECT problem, v.spi, {r6('100 * mean_accuracy', 'accuracy_pct', 7)}, {r6('p_bonferroni', 'p_bonferroni')}, p_bonferroni < 0.05, category, module FROM pvals v LEFT JOIN dim d ON v.spi = d.spi""",
    ),
)
def _(spark, sf):
    from pairspan.plans.tables import accuracy_table

    acc, nul = fx.accuracy_tables(spark, sf)
    out = accuracy_table(acc, nul, acc, nul, fx.supplier_dim(spark, sf))
    return _r(_r(out, "accuracy_pct", digits=7), "p_bonferroni")
