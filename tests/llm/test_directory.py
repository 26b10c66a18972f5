"""The directory of exact duplicates grows with its buckets, not with the texts, and a large one is not gathered at the driver."""

from pyspark.sql import functions as F

from pairspan.llm import exact_dedup as ed

FIELDS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket"]


def test_directory_has_the_cells_of_its_deepest_bucket(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    _, found = ed.build_index(df, 50)
    depths = [r.depth for r in found.table.collect()]
    assert found.bits == max(depths) < 10 and found.cells == len(depths) <= 2**found.bits  # before: a row for nearly each text
    _, one = ed.build_index(df, 5000)
    assert (one.bits, one.cells) == (0, 1)


def test_large_directories_are_not_broadcast(spark, monkeypatch):
    df = spark.range(600).selectExpr("id AS doc_id", "concat('t', id % 250) AS text")
    want = sorted(ed.exact_duplicates(df, 4).select(*FIELDS).collect())
    monkeypatch.setattr(ed, "BROADCAST_CELLS", 0)
    got = ed.exact_duplicates(df, 4)
    assert sorted(got.select(*FIELDS).collect()) == want and len(want) == 600
    _, found = ed.build_index(df, 4)
    plan = ed.routed(df.select(F.xxhash64("text").alias("key")), found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
