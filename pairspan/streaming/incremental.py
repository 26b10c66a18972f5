"""Not computing again what is already there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairspan.sources.files import sink_columnar


def skip_existing(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows whose keys have no output yet."""
    return requested.join(existing.select(*keys).distinct(), keys, "left_anti")


def append_missing(panel: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], spark: SparkSession) -> None:
    """Compute statistics of samples the output folder lacks and append them."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(path)
        todo = skip_existing(panel, done, ["sample_id"])
    except AnalysisException:  # nothing written yet
        todo = panel
    sink_columnar(compute(todo), path, ["spi"], mode="append")
