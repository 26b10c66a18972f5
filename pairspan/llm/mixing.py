"""Mix sources to target weights: repetition rates per source, whole copies and one hash-seeded Bernoulli copy per document.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a source without words has target 0 and its
documents are taken no time; repeated rows of one ``doc_id`` draw the same number; a null ``doc_id`` draws as the word ``null``. An empty
table gives no rows. Other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairspan.session import cut_lineage

MOST_REPEATS = 3  # a source's target never exceeds this many times its size
WEIGHTS = (1, 2, 3)  # by the place of the source in code point order, repeating
SEED = "42"


def n_words(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """0-based ``place`` of each source by code point, null last: ranges in order, numbers inside a range, and counts of the ranges before."""
    # strings sort by their UTF-8 bytes, which is the order of code points
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    All sizes together are shared by weight; a share above ``most`` times its source's size is cut there and the excess shared again by weight,
    until none is above. Each round is one aggregate over the table of sources, which is never gathered.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = cut_lineage(_placed(sums).select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(most)
    level, capped = 0.0, -1
    while True:
        full = (cap < F.col("weight") * F.lit(level)) if capped >= 0 else F.lit(False)
        got = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(full.cast("int")).alias("capped"),
        ).first()
        if not got["all"] or not got["weights"] or got["capped"] == capped:
            break
        level, capped = (got["all"] - got["held"]) / got["weights"], got["capped"]
    return placed.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate) copies and one more with the chance of the rest, drawn from an md5 of seed and id."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (F.floor(rate) + (drawn.cast("double") / F.lit(float(1 << 48)) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """One struct column ``mix`` (size, source_size, target, copies) beside the columns of ``docs``.

    Needs ``doc_id, text, source``. The table of sources meets the documents by their source; it is small unless sources are many, and then both
    sides are shuffled, where adaptive joins split a hot source.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row"), n_words(docs["text"]).alias("size"), docs["source"].alias("source"), docs["doc_id"].alias("doc_id"))
    targets = source_targets(docs.select(docs["source"], n_words(docs["text"]).alias("size")), weights, most)
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    met = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    made = F.struct("size", "source_size", "target", copies(rate, F.col("doc_id"), seed).alias("copies"))
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns], made.alias("mix"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    held = docs.select(F.struct(*docs.columns).alias("held"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))
    met = mix(held, **options).where(F.col("mix.copies") > 0)
    return met.select("held", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select("held.*")
