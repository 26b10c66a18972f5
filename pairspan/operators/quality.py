"""Filters of the pair-statistic table: halves, lists, and the two quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_self_pairs(fact: DataFrame) -> DataFrame:
    return fact.where("node_from <> node_to")


def direction_switch(fact: DataFrame, info: DataFrame) -> DataFrame:
    """Directed statistics keep both orders of a pair, undirected ones the first."""
    joined = fact.join(info.select("spi", "directionality"), "spi")
    return joined.where(
        (F.col("node_from") != F.col("node_to"))
        & ((F.col("directionality") == "Directed") | (F.col("node_from") < F.col("node_to")))
    )


def upper_triangle(fact: DataFrame) -> DataFrame:
    return fact.where("node_from < node_to")


def spi_in_list(fact: DataFrame, listed: DataFrame) -> DataFrame:
    """Keep statistics named in a list."""
    return fact.join(listed.select("spi").distinct(), "spi", "left_semi")


def qc_nonconstant(fact: DataFrame) -> DataFrame:
    """Statistics with more than one distinct value; missing counts as a value.

    Minimum against maximum answers "more than one" with constant state, where a distinct count
    would shuffle every value.
    """
    real = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    gap = F.max(F.when(real.isNull(), 1).otherwise(0))
    varied = (F.min(real) < F.max(real)) | ((gap == 1) & F.min(real).isNotNull())
    return fact.groupBy("spi").agg(varied.alias("keep")).where("keep").select("spi")


def qc_complete(fact: DataFrame, key: str = "sample_id") -> DataFrame:
    """Statistics present for every ``key`` of the table.

    (spi, key) is deduplicated with map-side combine first, so a statistic that holds most rows
    reaches the count as one row per key.
    """
    seen = fact.select("spi", key).distinct()
    total = fact.select(key).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    per_spi = seen.groupBy("spi").agg(F.count(F.lit(1)).alias("n"))
    wanted = per_spi.join(total, F.col("n") == F.col("n_all"))
    return wanted.select("spi")


def qc_keep(fact: DataFrame, key: str = "sample_id") -> DataFrame:
    """The fact table restricted to statistics that pass both rules."""
    good = qc_nonconstant(fact).intersect(qc_complete(fact, key))
    return fact.join(good, "spi", "left_semi")


def dropped_spis(listed: DataFrame, kept: DataFrame) -> DataFrame:
    return listed.select("spi").distinct().join(kept.select("spi").distinct(), "spi", "left_anti")
