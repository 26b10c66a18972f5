"""How alike statistics behave: correlation, hierarchical clusters, modules and graph edges.

Edges are rows ``(a, b, sim)`` with ``a < b``. The number of statistics is set by the catalogue
(hundreds), so the edge table stays small however large the data behind it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairspan.functions.numeric import pearson
from pairspan.functions.scalars import band_weight, module_label
from pairspan.operators.pairs import PAIR, pair_self_join
from pairspan.session import cut_lineage
from pairspan.spi.basic import average_ranks


def spi_correlation(panel: DataFrame, method: str = "spearman") -> DataFrame:
    """Correlation of every two statistics over the node pairs of a dataset.

    ``panel`` is the fact table in panel form: dataset as sample, statistic as node, node pair as
    step. It is the pairing of channels once more, so the same block join serves.
    """
    ranked = average_ranks(panel) if method == "spearman" else panel.withColumn("rank", F.col("signal"))
    pts = pair_self_join(ranked, value="rank", block=None)
    r = pts.groupBy(*PAIR).agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return r.select(F.col("sample_id").alias("dataset"), F.col("node_from").alias("a"), F.col("node_to").alias("b"), "r")


def fact_as_panel(fact: DataFrame) -> DataFrame:
    """Fact table to the panel form that :func:`spi_correlation` reads."""
    return fact.where("node_from <> node_to").select(
        "sample_id", F.col("spi").alias("node"), F.concat_ws("_", "node_from", "node_to").alias("t"), F.col("value").alias("signal")
    )


def spi_similarity_mean(corr: DataFrame, absolute: bool = True) -> DataFrame:
    r = F.abs("r") if absolute else F.col("r")
    return corr.groupBy("a", "b").agg(F.avg(r).alias("sim"))


def similarity_to_distance(edges: DataFrame) -> DataFrame:
    return edges.where("a < b").select("a", "b", (1 - F.coalesce("sim", F.lit(0.0))).alias("d"))


def wpgma_linkage(dist: DataFrame, cutoff: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Weighted average linkage of a complete distance table in rounds of mutual nearest neighbours.

    The linkage is reducible, so clusters that are each other's nearest may merge at once: the tree
    is the one that merging the closest pair first would give, up to ties. With a ``cutoff``, merges
    above it never happen and what is left are the clusters.

    The state of a round is one checkpointed table: open edges, members and merges so far.
    Returns the merges ``(round, a, b, height)`` and the members ``(spi, cluster)``. A cluster is
    named by its first member.
    """
    edges = dist.select(F.lit("edge").alias("kind"), F.lit(0).alias("round"), "a", "b", "d")
    ends = dist.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    state = cut_lineage(edges.unionByName(ends.select(F.lit("member").alias("kind"), F.lit(0).alias("round"), "a", F.col("a").alias("b"), F.lit(0.0).alias("d"))))
    for step in itertools.count(1):  # until a round merges nothing
        state = cut_lineage(_merge_round(state, step, cutoff))
        if state.where(F.col("kind").eqNullSafe("merge") & (F.col("round") == step)).isEmpty():
            break
    merges = state.where("kind = 'merge'").select("round", "a", "b", F.col("d").alias("height"))
    return merges, state.where("kind = 'member'").select(F.col("a").alias("spi"), F.col("b").alias("cluster"))


def _merge_round(state: DataFrame, step: int, cutoff: float | None) -> DataFrame:
    edges = state.where("kind = 'edge'")
    near = edges.where(F.col("d") <= cutoff) if cutoff is not None else edges
    ends = near.select(F.inline(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))))
    # ties go by distance, then by the names of the pair, so that the choice is mutual
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    best = ends.groupBy("a").agg(F.min(F.struct(F.round("d", 12).alias("r"), lo.alias("lo"), hi.alias("hi"), "d")).alias("n"))
    # a pair that both ends choose appears twice
    pairs = best.groupBy(F.col("n.lo").alias("a"), F.col("n.hi").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("n.d").alias("d")).where("n = 2")
    rename = pairs.select(F.col("b").alias("old"), F.col("a").alias("new"))
    to_a, to_b = (rename.select(F.col("old").alias(f"{c}_old"), F.col("new").alias(f"{c}_new")) for c in "ab")
    moved = (
        state.where("kind <> 'merge'")
        .join(to_b, F.col("b") == F.col("b_old"), "left")
        .join(to_a, (F.col("a") == F.col("a_old")) & (F.col("kind") == "edge"), "left")
        .select("kind", F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "d")
        .where("kind = 'member' OR a <> b")
    )
    is_edge = F.col("kind") == "edge"
    first, second = F.when(is_edge, F.least("a", "b")).otherwise(F.col("a")), F.when(is_edge, F.greatest("a", "b")).otherwise(F.col("b"))
    kept = moved.groupBy("kind", first.alias("a"), second.alias("b")).agg(F.avg("d").alias("d"))
    kept = kept.select("kind", F.lit(0).alias("round"), "a", "b", "d")
    merged = pairs.select(F.lit("merge").alias("kind"), F.lit(step).alias("round"), "a", "b", "d")
    return kept.unionByName(merged).unionByName(state.where("kind = 'merge'"))


def cluster_cut(dist: DataFrame, cutoff: float) -> DataFrame:
    """Members of the clusters whose merges are no higher than the cutoff."""
    return wpgma_linkage(dist, cutoff)[1]


def cluster_members(clusters: DataFrame, spi: str) -> DataFrame:
    """Statistics in the same cluster as a named one."""
    own = clusters.where(F.col("spi") == spi).select("cluster")
    return clusters.join(own, "cluster", "left_semi").select("spi", "cluster")


def sub_similarity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    m = members.select("spi")
    inner = edges.join(m.withColumnRenamed("spi", "a"), "a", "left_semi")
    return inner.join(m.withColumnRenamed("spi", "b"), "b", "left_semi").select(*edges.columns)


def module_names(clusters: DataFrame) -> DataFrame:
    """``M01``... by size, then first member; clusters of one are Singleton."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("spi").alias("first"))
    many = sizes.where("n > 1").withColumn("no", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
    named = many.select("cluster", module_label(F.col("no")).alias("module"))
    return clusters.join(named, "cluster", "left").select("spi", F.coalesce("module", F.lit("Singleton")).alias("module"))


# ---- graph -----------------------------------------------------------------------------------


def graph_edges(edges: DataFrame) -> DataFrame:
    """Non-zero cells are edges; missing counts as zero."""
    return edges.withColumn("weight", F.coalesce("sim", F.lit(0.0))).where("weight <> 0").select("a", "b", "weight")


def edge_thresholds(edges: DataFrame) -> DataFrame:
    """One row ``t1, t2, t3``: percentiles 99, 95, 90 for 50 nodes or more, else 0.9, 0.7, 0.5."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n").alias("n_nodes"))
    filled = F.coalesce("sim", F.lit(0.0))
    top = edges.agg(F.percentile(filled, F.array(F.lit(0.99), F.lit(0.95), F.lit(0.9))).alias("q"))
    n = nodes.scalar()
    fixed = (0.9, 0.7, 0.5)
    return top.select(*[F.when(n >= 50, F.col("q")[i]).otherwise(fixed[i]).alias(f"t{i + 1}") for i in range(3)])


def edge_squared(edges: DataFrame, thresholds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights and thresholds squared."""
    t = thresholds.select(*[(F.col(c) * F.col(c)).alias(c) for c in ("t1", "t2", "t3")])
    return edges.withColumn("weight", F.col("weight") * F.col("weight")), t


def edge_weight_band(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Line weight of every edge from the band its similarity falls in."""
    bars = tuple(thresholds.select(c).scalar() for c in ("t1", "t2", "t3"))
    return edges.withColumn("band", band_weight(F.col("weight"), bars))
