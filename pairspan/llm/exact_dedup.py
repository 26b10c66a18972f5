"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

Keys are 64-bit hashes of the normalised texts. The directory doubles until no bucket holds more than ``capacity`` different keys, or until ``max_depth`` bits are used; a bucket
that is over the capacity even then is read through all the same. Copies inside one task are made one first; then every text goes through the directory to its bucket, and the
bucket's owner task decides: it compares the bytes of the texts of each key, makes equal ones one entry and links different texts of one key to a chain. The index is written to the shared
folder, and documents look their entry up in their bucket, along the chain of their key by digest.

Defined results: null text counts as empty; very long texts are compared whole; the smallest non-null ``doc_id`` of a group stays, a group of null ids keeps none; repeated rows of one
``doc_id`` with one text are one document and get the same answer. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairspan.session import cut_lineage, fresh_path

CAPACITY = 512  # different keys of a bucket
MAX_DEPTH = 20  # bits of the largest directory
BROADCAST_CELLS = 1 << 16  # rows of a directory that is broadcast

INDEX = "bucket long, depth int, key long, chain int, sha256 string, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, bits: int | Column) -> Column:
    """The first ``bits`` bits of the key as a number."""
    if isinstance(bits, int):
        return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - bits).cast("int")))


class Directory(NamedTuple):
    """``table``: ``cell, depth``, how many bits the bucket of each cell (prefix of ``bits`` bits) uses; ``bits`` is the depth of the deepest bucket."""

    table: DataFrame
    bits: int
    cells: int


def _beside(table: DataFrame, n: int) -> DataFrame:
    """A small table is broadcast; a larger one is shuffled, whatever its size on disk, since the driver would hold it."""
    return F.broadcast(table) if n <= BROADCAST_CELLS else table.hint("merge")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> Directory:
    """How deep the buckets are. ``keys`` has each key once.

    A bucket of depth d splits while it holds more than ``capacity`` keys. Counts of the finest cells are summed by prefix for all depths at once; the directory has a row for each cell of the deepest
    bucket's bits, about two for each ``capacity`` keys with an even hash and at most 2^max_depth.
    """
    fine = cut_lineage(keys.groupBy(_prefix(F.col("key"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")))

    def above(cells: DataFrame, depth: int) -> DataFrame:
        shift = lambda d: F.call_function("shiftright", F.col("cell"), (F.lit(depth) - d).cast("int"))
        at = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("d"), shift(d).alias("prefix")))
        return cells.withColumn("at", F.explode(at)).select(*cells.columns, "at.d", "at.prefix")

    over = cut_lineage(above(fine, max_depth).groupBy("d", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") > capacity).select("d", "prefix"))
    n_over, deepest = over.agg(F.count(F.lit(1)), F.max("d")).first()
    bits = 0 if deepest is None else deepest + 1
    cells = fine.select(F.shiftright("cell", max_depth - bits).alias("cell")).distinct()
    if bits:
        deep = above(cells, bits).join(_beside(over, n_over), ["d", "prefix"]).groupBy("cell").agg((F.max("d") + 1).alias("deep"))
        cells = cells.join(deep, "cell", "left").select("cell", F.coalesce("deep", F.lit(0)).cast("int").alias("depth"))
    else:
        cells = cells.withColumn("depth", F.lit(0))
    table = cut_lineage(cells)
    return Directory(table, bits, table.count())


def routed(rows: DataFrame, found: Directory) -> DataFrame:
    """Rows with the ``bucket`` and ``depth`` that the directory has for their key."""
    met = rows.withColumn("cell", _prefix(F.col("key"), found.bits)).join(_beside(found.table, found.cells), "cell").drop("cell")
    return met.withColumn("bucket", _prefix(F.col("key"), F.col("depth")))


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, Directory]:
    """The written index (see ``INDEX``; a row for each different text) and the directory."""
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError("the directory has 1 to 20 bits")
    spark = docs.sparkSession
    text = normalised(docs["text"])
    found = directory(docs.select(hashed(text).alias("key")).distinct(), capacity, max_depth)
    keyed = docs.select(text.alias("body"), docs["doc_id"].alias("doc_id")).select(hashed(F.col("body")).alias("key"), "body", "doc_id", F.spark_partition_id().alias("task"))
    # copies of one task become one row, so that a text with very many copies reaches its bucket once for a task
    once = keyed.groupBy("task", "key", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    owned = routed(once.drop("task"), found).repartition("bucket")
    # in the owner task: grouping compares the bytes of a key's texts
    entries = owned.groupBy("bucket", "depth", "key", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    entries = entries.select("bucket", "depth", "key", F.sha2("body", 256).alias("sha256"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.asc_nulls_last("keep_id"), "sha256"))
    index_at = fresh_path(spark, "index")
    entries.select("bucket", "depth", "key", chain.alias("chain"), "sha256", "keep_id", "group_size").write.parquet(index_at)
    return spark.read.schema(INDEX).parquet(index_at), found


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain`` for every row of ``docs`` (doc_id, text).

    A document reads the chain of its key in its bucket and takes the entry of its digest. The owners told texts apart by their bytes; should two of a chain ever share
    a digest, the run stops with an error instead of mixing them up.
    """
    index, cells = build_index(docs, capacity, max_depth, hashed)
    same = F.count(F.lit(1)).over(Window.partitionBy("bucket", "key", "sha256"))
    safe = F.when(same > 1, F.raise_error(F.lit("two texts share key and digest"))).otherwise(F.col("keep_id"))
    index = index.select("bucket", "key", "chain", "sha256", safe.alias("keep_id"), "group_size")
    looked = docs.select(docs["doc_id"].alias("doc_id"), normalised(docs["text"]).alias("body")).select("doc_id", hashed(F.col("body")).alias("key"), F.sha2("body", 256).alias("sha256"))
    met = routed(looked, cells).drop("depth").join(index, ["bucket", "key", "sha256"])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"), "bucket", "chain")
