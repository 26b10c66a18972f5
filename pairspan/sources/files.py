"""Reading series, dimensions and result files; writing tables.

Every read has an explicit schema. A Spark table has no row order, so readers that need the order
of lines carry it as a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def line_order() -> Column:
    """Sortable place of a line in its file: start of the block, then place in the block."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def scan_wide_series(spark: SparkSession, path: str, partitions: str = "") -> DataFrame:
    """Lines ``v1,v2,...,class`` with ``@`` and ``%`` header lines: one row per sample.

    Columns: file, line (order key), values, cls, and any ``partitions`` found in folder names.
    """
    schema = ", ".join(["value string"] + ([partitions] if partitions else []))
    lines = spark.read.schema(schema).text(path).select("*", F.col("_metadata.file_path").alias("file"), line_order().alias("line"))
    body = lines.where(~F.col("value").rlike("^[@%]") & (F.trim("value") != ""))
    parts = F.split("value", ",")
    keep = [c for c in body.columns if c != "value"]
    return body.select(
        *keep,
        F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda v: v.try_cast("double")).alias("values"),
        F.element_at(parts, -1).alias("cls"),
    )


def scan_headerless_csv(spark: SparkSession, path: str, names: list[str], prefix: str = "t int") -> DataFrame:
    """Numbers without a header, named by position."""
    cols = ", ".join([prefix, *[f"`{n}` double" for n in names]])
    return spark.read.schema(cols).csv(path, header=False)


def scan_headerless_lookup(spark: SparkSession, path: str, lookup: DataFrame, width: int, prefix: str = "t int") -> DataFrame:
    """Numbers without a header in long form; ``lookup`` (ordinal from 1, node) names the columns that follow those of ``prefix``.

    A column that the lookup does not name is left out; an ordinal beyond ``width`` meets no column.
    """
    own = scan_headerless_csv(spark, path, [f"_{i}" for i in range(1, width + 1)], prefix)
    keys = [c for c in own.columns if not c.startswith("_")]
    long = own.unpivot(keys, [f"_{i}" for i in range(1, width + 1)], "at", "signal")
    return long.withColumn("ordinal", F.substring("at", 2, 9).cast("int")).join(lookup, "ordinal").select(*keys, "node", "signal")


def scan_file_pattern(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """Every csv below folders or files whose name holds ``pattern``; identity from the dotted name."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).csv(f"{root}/*{pattern}*")
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/=]*{pattern}[^/]*)", 1)
    part = F.split(name, r"\.")
    return df.select("*", part[0].alias("subject"), part[1].alias("scan"), part[2].alias("session"))


def scan_csv_dim(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Dimension with a header; a byte-order mark is removed, blanks are NULL, bad numbers are NULL."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("nullValue", "").csv(path)

    def clean(f: T.StructField) -> Column:
        value = F.regexp_replace(F.col(f.name), f"^{BOM}|\r$", "")
        return F.nullif(value, F.lit("")).try_cast(f.dataType).alias(f.name)

    return raw.select(*[clean(f) for f in schema.fields])


def scan_matrix_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Square matrix with row names, straight to edges ``a, b, sim`` with a < b."""
    m = spark.read.schema(", ".join(["a string", *[f"`{n}` double" for n in names]])).option("header", True).csv(path)
    return m.unpivot(["a"], names, "b", "sim").where("a < b")


def scan_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files; unreadable ones are skipped and the rest go on."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)


def rejected_files(spark: SparkSession, path: str, good: DataFrame) -> DataFrame:
    """Files below ``path`` that gave no row. Names only: contents are not read again."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    seen = good.select(F.col("_metadata.file_path").alias("file")).distinct()
    plain = F.regexp_replace("file", "^file:/+", "/")
    return every.withColumn("file", plain).join(seen.withColumn("file", plain), "file", "left_anti")


def file_faults(spark: SparkSession, path: str) -> DataFrame:
    """``file, reason`` of the files below ``path`` that cannot be read to their end, half-broken ones included.

    Each file is read once, by a task that holds it whole: meant for folders with one result file for each sample.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"file": [], "reason": []}
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                try:
                    for _ in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches():
                        pass
                except (pa.ArrowException, OSError, ValueError) as fault:
                    out["file"].append(name)
                    out["reason"].append(f"{type(fault).__name__}: {fault}"[:200])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), ("reason", pa.string())]))

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return found.mapInArrow(check, "file string, reason string").withColumn("file", F.regexp_replace("file", "^file:/+", "/"))


def scan_mts_database(spark: SparkSession, path: str, n: int | None = None, label: str | None = None) -> DataFrame:
    """Long table ``dataset, labels, node, t, value``; optionally the first n datasets or one label."""
    df = spark.read.schema("dataset string, labels array<string>, node string, t int, value double").parquet(path)
    if label is not None:
        df = df.where(F.array_contains("labels", label))
    if n is not None:
        first = df.select("dataset").distinct().orderBy("dataset").limit(n)
        df = df.join(F.broadcast(first), "dataset", "left_semi")  # n names
    return df


def sink_columnar(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, one folder per value of ``by``.

    Rows are spread by the folder key and a salt, so a statistic with most rows is written by many
    tasks, and a small one does not leave a file per task. The salt grows with the session's shuffle partitions.
    """
    if by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        df.repartition(*by, salt).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sample_arrays(panel: DataFrame, value: str = "z") -> DataFrame:
    """One row per sample and node with the values in time order."""
    s = panel.groupBy("sample_id", "node").agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("s"))
    return s.select("sample_id", "node", F.col(f"s.{value}").alias("values"))


def sample_manifest(panel: DataFrame) -> DataFrame:
    """Samples with the size of their matrix; dimension order is process, then sample."""
    per_node = panel.groupBy("sample_id", "node").agg(F.count(F.lit(1)).alias("n_t"))
    return per_node.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("n_t").alias("n_t"), F.lit("ps").alias("dim_order")
    )
