"""Similarity of statistics, clusters and graph edges, on the embedding study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspan import fixtures as fx
from pairspan.functions.numeric import rounded
from pairspan.operators import quality
from pairspan.operators import similarity as sm
from pairspan.workloads.registry import query
from pairspan.workloads.sqltext import SPI, r6, with_

_SIM = """WITH em AS (SELECT CAST(label AS VARCHAR) AS dataset, vec_id, concat('d', lpad(CAST(i - 1 AS VARCHAR), 2, '0')) AS spi, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
rk AS (SELECT dataset, vec_id, spi, rank() OVER (PARTITION BY dataset, spi ORDER BY v) + (count(*) OVER (PARTITION BY dataset, spi, v) - 1) / 2.0 AS r FROM em),
co AS (SELECT a.dataset, a.spi AS a, b.spi AS b, corr(a.r, b.r) AS r FROM rk a JOIN rk b ON a.dataset = b.dataset AND a.vec_id = b.vec_id AND a.spi < b.spi GROUP BY 1, 2, 3),
sim AS (SELECT a, b, avg(abs(r)) AS sim FROM co GROUP BY 1, 2)
"""
_BARS = ", th AS (SELECT quantile_cont(coalesce(sim, 0), 0.99) AS t1, quantile_cont(coalesce(sim, 0), 0.95) AS t2, quantile_cont(coalesce(sim, 0), 0.9) AS t3 FROM sim) "
_BARS_SMALL = ", th AS (SELECT 0.9 AS t1, 0.7 AS t2, 0.5 AS t3) "


def _corr(spark: SparkSession, sf: str) -> DataFrame:
    return sm.spi_correlation(fx.embedding_panel(spark, sf))


def _sim(spark: SparkSession, sf: str) -> DataFrame:
    return sm.spi_similarity_mean(_corr(spark, sf))


def _cutoff(dist: DataFrame) -> float:
    """A cut that leaves some clusters: the 2 % quantile of the distances (the published study used 0.76)."""
    return dist.agg(F.percentile("d", F.lit(0.02))).first()[0]


@query("spi_correlation", _SIM + f"SELECT dataset, a, b, {r6('r', 'r')} FROM co")
def _(spark, sf):
    return _corr(spark, sf).withColumn("r", rounded("r"))


@query("spi_similarity_mean", _SIM + f"SELECT a, b, {r6('sim', 'sim')} FROM sim")
def _(spark, sf):
    return _sim(spark, sf).withColumn("sim", rounded("sim"))


@query("similarity_to_distance", _SIM + f"SELECT a, b, {r6('1 - coalesce(sim, 0)', 'd')} FROM sim WHERE a < b")
def _(spark, sf):
    return sm.similarity_to_distance(_sim(spark, sf)).withColumn("d", rounded("d"))


@query("wpgma_linkage")
def _(spark, sf):
    return sm.wpgma_linkage(sm.similarity_to_distance(_sim(spark, sf)))[0]


def _clusters(spark, sf) -> tuple[DataFrame, DataFrame]:
    dist = sm.similarity_to_distance(sm.cut_lineage(_sim(spark, sf)))
    return dist, sm.cluster_cut(dist, _cutoff(dist))


@query("cluster_cut")
def _(spark, sf):
    return _clusters(spark, sf)[1]


@query("cluster_members")
def _(spark, sf):
    return sm.cluster_members(_clusters(spark, sf)[1], "d00")


@query("module_names")
def _(spark, sf):
    return sm.module_names(_clusters(spark, sf)[1])


@query("sub_similarity", _SIM + f", mem AS (SELECT b AS spi FROM sim WHERE a = 'd00' AND sim >= 0.11 UNION SELECT 'd00') SELECT a, b, {r6('sim', 'sim')} FROM sim WHERE a IN (FROM mem) AND b IN (FROM mem)")
def _(spark, sf):
    sim = _sim(spark, sf)
    near = sim.where("a = 'd00' AND sim >= 0.11").select(F.explode(F.array("a", "b")).alias("spi")).distinct()
    return sm.sub_similarity(sim, near).withColumn("sim", rounded("sim"))


@query("graph_edges", _SIM + f"SELECT a, b, {r6('sim', 'weight')} FROM sim WHERE sim <> 0")
def _(spark, sf):
    return sm.graph_edges(_sim(spark, sf)).withColumn("weight", rounded("weight"))


@query("edge_thresholds", _SIM + _BARS + f"SELECT {r6('t1', 't1')}, {r6('t2', 't2')}, {r6('t3', 't3')} FROM th")
def _(spark, sf):
    return sm.edge_thresholds(_sim(spark, sf)).select(*[rounded(c).alias(c) for c in ("t1", "t2", "t3")])


@query("edge_squared", _SIM + _BARS + f"SELECT a, b, {r6('sim * sim', 'weight', 8)}, {r6('t1 * t1', 't1', 8)} FROM sim, th WHERE sim <> 0")
def _(spark, sf):
    sim = _sim(spark, sf)
    edges, bars = sm.edge_squared(sm.graph_edges(sim), sm.edge_thresholds(sim))
    first = bars.select("t1").scalar()
    return edges.select("a", "b", rounded("weight", 8).alias("weight"), rounded(first, 8).alias("t1"))


@query("edge_weight_band", _SIM + _BARS + "SELECT a, b, CAST(CASE WHEN sim >= t1 THEN 2.0 WHEN sim >= t2 THEN 0.75 WHEN sim >= t3 THEN 0.1 ELSE 0 END AS DOUBLE) AS band FROM sim, th WHERE sim <> 0")
def _(spark, sf):
    sim = _sim(spark, sf)
    return sm.edge_weight_band(sm.graph_edges(sim), sm.edge_thresholds(sim)).select("a", "b", "band")


# the whole study on pair statistics: quality rule, correlations over node pairs, mean over samples, clusters


def _study(spark: SparkSession, sf: str) -> DataFrame:
    fact = fx.spi_fact(spark, sf).where("node_from <> node_to AND value IS NOT NULL").withColumn("value", F.round("value", 8))
    kept = fact.join(quality.qc_nonconstant(fact), "spi", "left_semi")
    return sm.spi_similarity_mean(sm.spi_correlation(sm.fact_as_panel(kept)))


_STUDY = f""", fc AS MATERIALIZED (SELECT spi, sample_id, concat_ws('_', node_from, node_to) AS pair, round(value, 8) AS v FROM spi WHERE node_from <> node_to AND value IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY sample_id, spi ORDER BY v) + (count(*) OVER (PARTITION BY sample_id, spi, v) - 1) / 2.0 AS r
  FROM fc WHERE spi IN (SELECT spi FROM fc GROUP BY 1 HAVING min(v) < max(v))),
pt AS (SELECT a.sample_id, a.spi AS a, b.spi AS b, a.r AS x, b.r AS y FROM rk a JOIN rk b ON a.sample_id = b.sample_id AND a.pair = b.pair AND a.spi < b.spi),
co AS (SELECT sample_id, a, b, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS r FROM pt GROUP BY 1, 2, 3)
SELECT a, b, {r6('avg(abs(r))', 'sim')} FROM co GROUP BY 1, 2"""


@query("study_similarity", with_(SPI, _STUDY))
def _(spark, sf):
    return _study(spark, sf).withColumn("sim", rounded("sim"))


@query("study_modules")
def _(spark, sf):
    dist = sm.similarity_to_distance(sm.cut_lineage(_study(spark, sf)))
    return sm.module_names(sm.cluster_cut(dist, dist.agg(F.percentile("d", F.lit(0.5))).first()[0]))
