"""Wide to long and back, keys, and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_to_long(df: DataFrame, values: str = "values", t: str = "t", signal: str = "signal") -> DataFrame:
    """One row per element of the array column ``values``."""
    keep = [c for c in df.columns if c != values]
    return df.select(*keys_of(keep), F.posexplode(values).alias(t, signal))


def keys_of(names: list[str]) -> list[Column]:
    return [F.col(c) for c in names]


def columns_to_long(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def to_wide(df: DataFrame, keys: list[str], names: str, values: str, levels: list) -> DataFrame:
    """Pivot with the levels given, so Spark needs no extra pass to find them."""
    return df.groupBy(*keys).pivot(names, levels).agg(F.first(values, ignorenulls=True))


def spi_matrix(fact: DataFrame, nodes: list[str]) -> DataFrame:
    """Rows ``node_from``, columns ``node_to``, per statistic and sample."""
    return to_wide(fact, ["spi", "sample_id", "node_from"], "node_to", "value", nodes)


def matrix_to_pairs(matrix: DataFrame, nodes: list[str]) -> DataFrame:
    """Back to long form, leaving out missing cells."""
    long = matrix.unpivot(["spi", "sample_id", "node_from"], nodes, "node_to", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def transpose_matrix(df: DataFrame, row: str, cols: list[str], name: str, levels: list) -> DataFrame:
    """Columns become rows and the values of ``row`` become columns."""
    return to_wide(df.unpivot([row], cols, name, "value"), [name], row, "value", levels)


def node_pair(sep: str = "_") -> Column:
    return F.concat_ws(sep, "node_from", "node_to")


def feature_vectors(long: DataFrame, keys: list[str], feature: str = "feature", value: str = "value", fill: float = 0.0) -> DataFrame:
    """One dense array per row key, in feature-name order, instead of thousands of pivot columns.

    All rows of a statistic (of everything, if ``spi`` is no key) have the same features in the same places; a cell that a row lacks is ``fill``.
    A row that has all of them is taken as it is, so only rows with gaps look names up.
    """
    within = F.col("spi") if "spi" in keys else F.lit("")
    entry = F.struct(F.col(feature).alias("f"), F.col(value).alias("v"))
    packed = long.withColumn("_of", within).groupBy("_of", *keys).agg(F.array_sort(F.collect_list(entry)).alias("p"))
    names = long.select(within.alias("_of"), F.col(feature).alias("f")).distinct().groupBy("_of").agg(F.array_sort(F.collect_list("f")).alias("features"))
    held = F.map_from_entries("p")
    filled = F.transform("features", lambda f: F.when(F.map_contains_key(held, f), held[f]).otherwise(F.lit(fill)))
    vector = F.when(F.size("p") == F.size("features"), F.col("p.v")).otherwise(filled)
    return packed.join(names, "_of").select(*keys, "features", vector.alias("vector"))


def missing_to_number(col: Column) -> Column:
    """NaN and NULL become 0; infinities become the largest double of their sign."""
    big = F.lit(1.7976931348623157e308)
    inf = F.lit(float("inf"))
    return F.when(col.isNull() | F.isnan(col), 0.0).when(col == inf, big).when(col == -inf, -big).otherwise(col)
