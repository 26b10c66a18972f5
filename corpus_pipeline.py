"""A corpus from documents: toxic ones go, lines that repeat, near copies and benchmark leaks go, then sources are mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes every result to the shared folder and rereads it, so a lost executor costs
one stage's tasks at most. The last stage returns each document as many times as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairspan.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from pairspan.session import cut_lineage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are like earlier ones."""
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the shingles and the radius that op6 links with."""
    return simhash.keep_representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", leaks), ("mixing", mixture)]

ORACLE_SQL = None  # fits and alignments are no SQL; the stages are tested against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
