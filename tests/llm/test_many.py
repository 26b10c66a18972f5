"""Many languages, and labels that mostly belong to other documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairspan.llm import langid, toxicity


def corpus(n_languages, texts=3):
    """Each language has syllables of its own order."""
    rows = []
    for k in range(n_languages):
        rng = random.Random(k)
        stock = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(12)]
        rows += [(k * texts + i, " ".join(rng.choice(stock) for _ in range(25)), f"l{k:04d}") for i in range(texts)]
    return rows


def right(spark, n):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    fitted = langid.fit(docs)
    assert fitted.table.count() == n and fitted.blocks == -(-n // langid.LANGUAGES_TOGETHER)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, fitted).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 + 1e-9 for _, s in got.values())
    return sum(got[i][0] == lang for i, _, lang in rows) / len(rows)


def test_three_hundred_languages(spark):
    assert right(spark, 300) > 0.98


def test_two_thousand_languages(spark):
    assert right(spark, 2000) > 0.95


def test_blocks_change_nothing(spark):
    rows = [*corpus(7), (90, None, "l0001"), (91, "12 34", None), (92, "words of no language known", None), (None, "bada", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    results = []
    for together in (64, 2):
        got = langid.predict(docs, langid.fit(docs, together=together)).collect()
        results.append(sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got))
    assert results[0] == results[1] and len(results[0]) == len(rows)


def test_repeated_rows_and_many_null_ids_are_learned_once(spark):
    rows = corpus(3)
    again = [(None, rows[0][1], "l0000")] * 500 + rows * 3
    docs = spark.createDataFrame([*rows, *again], "doc_id long, text string, lang string")
    counts = {r.lang: len(r.ids) for r in langid.fit(docs).table.collect()}
    alone = {r.lang: len(r.ids) for r in langid.fit(spark.createDataFrame(rows, docs.schema)).table.collect()}
    assert counts == alone


def test_labels_of_other_documents_change_no_flag(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    other = spark.range(10**9, 10**9 + 400_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("quality"), (F.col("id") % 2).alias("toxic"))
    usual = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    many = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.select("doc_id", "quality", "toxic").unionByName(other))).collect()}
    assert usual == many and sum(s >= 0.5 for s in usual.values()) > 20


def test_repeated_labels_that_disagree_count_as_toxic(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (9, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.usable_labels(docs, labels).collect()) == [(1, 1, 2), (2, 0, 1)]
