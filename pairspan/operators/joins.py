"""Dimension joins. Dimensions here are channel, region, sample-attribute or statistic lists.

Only statistic, channel and region lists, whose size the study design fixes, are hinted for
broadcast. Sample metadata grows with the data, so Spark chooses by its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_node_lookup(df: DataFrame, lookup: DataFrame, key: str = "proc") -> DataFrame:
    """Channel code to node name, keeping channels the lookup lacks."""
    return df.join(lookup, key, "left").drop(key)


def join_node_lookup_twice(fact: DataFrame, lookup: DataFrame) -> DataFrame:
    """Name both ends of a pair; the codes are dropped."""
    f = lookup.select(F.col("proc").alias("proc_from"), F.col("node").alias("node_from"))
    t = lookup.select(F.col("proc").alias("proc_to"), F.col("node").alias("node_to"))
    return fact.join(f, "proc_from", "left").join(t, "proc_to", "left").drop("proc_from", "proc_to")


def join_region_network(df: DataFrame, regions: DataFrame, key: str = "region") -> DataFrame:
    return df.join(regions, key, "left")


def network_mean(df: DataFrame, keys: list[str], value: str = "signal") -> DataFrame:
    """Mean over the regions of a network, skipping NaN and NULL."""
    clean = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(clean).alias(value))


def join_sample_metadata(fact: DataFrame, meta: DataFrame, key: str = "sample_id") -> DataFrame:
    return fact.join(meta, key, "left")


def semi_join_metadata(meta: DataFrame, fact: DataFrame, key: str = "sample_id") -> DataFrame:
    """Metadata of samples that have results."""
    return meta.join(fact.select(key).distinct(), key, "left_semi")


def join_spi_info(df: DataFrame, info: DataFrame) -> DataFrame:
    return df.join(info, "spi", "left")


def join_colours(df: DataFrame, colours: DataFrame) -> DataFrame:
    """Category on one side, module on the other."""
    return df.join(colours, df["category"] == colours["module"], "left").drop(colours["module"])
