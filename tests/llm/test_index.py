"""The exact index: buckets by the directory, bytes decide, capacity changes no row."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from pairspan.llm import exact_dedup as ed

FIELDS = "doc_id long, text string, bucket int, key string"


def rows():
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb", "A b", "long " * 50_000, "long " * 50_000, *[f"text {k % 40}" for k in range(200)]]
    return [(k if k % 17 else None, t, 1, "x") for k, t in enumerate(texts)] + [(3, "a b", 1, "x"), (4, "a b", 1, "x")]


def plain(data):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in data]
    count = Counter(body)
    keep = {}
    for (i, *_), b in zip(data, body, strict=True):
        keep[b] = min((k for k in (keep.get(b), i) if k is not None), default=None)
    return sorted((str(i), str(keep[b]), count[b], i is not None and i == keep[b], hashlib.sha256(b.encode()).hexdigest()) for (i, *_), b in zip(data, body, strict=True))


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_capacity_and_depth_change_buckets_but_no_row(spark):
    data = rows()
    df = spark.createDataFrame(data, FIELDS).repartition(5)
    want = plain(data)
    buckets = {}
    for capacity, depth in ((512, 20), (1, 20), (4, 8), (2, 3), (1, 1)):
        out = ed.exact_duplicates(df, capacity, depth).cache()
        assert found(out) == want
        buckets[capacity, depth] = out.select("bucket").distinct().count()
    assert buckets[512, 20] == 1 < buckets[4, 8] <= buckets[1, 20] and buckets[2, 3] <= 8 and buckets[1, 1] <= 2


def test_bytes_decide_when_keys_collide(spark):
    data = rows()
    df = spark.createDataFrame(data, FIELDS).repartition(5)
    for hashed in (lambda c: F.lit(7).cast("long") + 0 * F.length(c), lambda c: F.length(c).cast("long") % 3):
        out = ed.exact_duplicates(df, 2, 6, hashed).cache()
        assert found(out) == plain(data)
        assert out.agg(F.max("chain")).first()[0] > 10


def test_buckets_hold_at_most_their_capacity(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    index, table = ed.build_index(df, 50)
    held = index.groupBy("bucket", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    assert sum(r.n for r in held) == 3000 and max(r.n for r in held) <= 50
    assert all((r.lo & (2**64 - 1)) >> (64 - r.depth) == r.bucket == (r.hi & (2**64 - 1)) >> (64 - r.depth) for r in held)
    # a bucket splits only where it must: its parent holds too many
    for r in held:
        parent = sum(q.n for q in held if q.depth >= r.depth and q.bucket >> (q.depth - r.depth + 1) == r.bucket >> 1)
        assert r.depth == 0 or parent > 50
    assert ed.exact_duplicates(df.limit(0)).count() == 0
