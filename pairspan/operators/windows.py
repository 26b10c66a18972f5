"""Ordering, numbering and standardisation.

Standardisation joins group statistics back instead of using a window, so a series that holds a
large part of the rows is summed by partial aggregation and never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairspan.functions.numeric import nan_to_null, ratio


STEP_BLOCK = 4096  # steps or lines numbered together


def number_rows(df: DataFrame, keys: list[str], coarse: Column, order: list, name: str) -> DataFrame:
    """1-based row number within ``keys``, in the order of ``coarse``, then ``order``.

    Rows are counted per coarse value and the counts summed up; only rows of one coarse value are sorted
    together. A key that holds a large part of the rows is thus numbered by many tasks.
    """
    tagged = df.withColumn("_c", coarse)
    counts = tagged.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_n")
    base = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_c"])], before.alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(*order))
    same = F.lit(True)
    for i, k in enumerate([*keys, "_c"]):  # NULL keys keep their rows
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = tagged.withColumn("_local", local).join(base, same)
    return out.withColumn(name, (F.col("_base") + F.col("_local")).cast("int")).select(*df.columns, name)


def row_number_time(df: DataFrame, keys: list[str], order: str = "t", name: str = "timepoint_num") -> DataFrame:
    """Number the steps of each series 1..T in explicit time order."""
    return number_rows(df, keys, F.floor(F.col(order) / STEP_BLOCK), [order], name)


def row_number_id(df: DataFrame, file_col: str, line_col: str, name: str = "id") -> DataFrame:
    """Number the samples of each file in line order.

    ``line_col`` is the (block, place) key of a file reader or a number.
    """
    is_key = df.schema[line_col].dataType.typeName() == "struct"
    coarse = F.col(f"{line_col}.block") if is_key else F.floor(F.col(line_col) / STEP_BLOCK)
    return number_rows(df, [file_col], coarse, [line_col], name)


def join_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Left-join aggregates of ``keys`` to every row."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys, "left")


def zscore_series(
    df: DataFrame, keys: tuple[str, ...] = ("sample_id", "node"), value: str = "signal", name: str = "z"
) -> DataFrame:
    """(x - mean) / sd with the n-1 standard deviation; NULL for a constant series."""
    clean = nan_to_null(F.col(value).cast("double"))
    out = join_group_stats(df, list(keys), _mean=F.avg(clean), _sd=F.stddev_samp(clean))
    return out.withColumn(name, ratio(clean - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def zscore_features(df: DataFrame, task: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Standardise each feature with the mean and population sd of the training rows of its task.

    A feature that does not vary keeps scale 1.
    """
    on_train = F.when(F.col("is_train"), F.col(value))
    out = join_group_stats(df, [*task, feature], _mean=F.avg(on_train), _sd=F.stddev_pop(on_train))
    scale = F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(F.lit(1.0))
    return out.withColumn("scaled", (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_sd")
