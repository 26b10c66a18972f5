"""Cross-tokenizer alignment against a plain version that encodes whole texts and cuts them at common ends."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairspan.llm import token_align
from pairspan.llm.arrays import Hasher, chunks
from pairspan.llm.queries import QUERIES

FIELDS = "doc_id long, text string, n_a string, chunk int"


@pytest.fixture(scope="module")
def encoders():
    return token_align.byte_table_a(token_align.VOCABULARY_A), token_align.byte_table_b(token_align.VOCABULARY_B)


def plain(texts, encoders):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    (tok, bytes_a), (model, bytes_b) = encoders
    groups, links = [], []
    for text in texts:
        own = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            body = b" " + text.encode()
            if b"".join(bytes_a[i] for i in a) == body == b"".join(bytes_b[i] for i in b):
                ends_b = {int(e): k + 1 for k, e in enumerate(np.cumsum([len(bytes_b[i]) for i in b]))}
                at_a = at_b = done = 0
                for k, i in enumerate(a):
                    done += len(bytes_a[i])
                    if done in ends_b:
                        own.append((a[at_a : k + 1], b[at_b : ends_b[done]]))
                        at_a, at_b = k + 1, ends_b[done]
        groups.append(own)
        links.append(Counter((x, y) for g in own for x in g[0] for y in g[1]))
    count = Counter(p for c in links for p in c)
    top: dict[int, int] = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for own, met in zip(groups, links, strict=True):
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own).encode()).hexdigest() if own else ""
        best = sum(m for p, m in met.items() if count[p] == top[p[0]])
        out.append((sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(met.values()), best, sum(m * count[p] for p, m in met.items()), digest))
    return out


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_groups_are_cut_at_common_ends(a, b):
    x, y = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    last = max(x[-1], y[-1]) + 1
    x, y = [*x, last], [*y, last]
    at_a, at_b = token_align.align(x, y)
    common = sorted(set(x) & set(y))
    assert at_a.tolist() == [0, *[x.index(e) + 1 for e in common[:-1]]]
    assert at_b.tolist() == [0, *[y.index(e) + 1 for e in common[:-1]]]


ODD = [
    "plain words, and more words.", "", None, " leading space", "two  spaces and   three", "tab\tand\nnew line\r\n", "ends in space ", "a b c  d  e", "x  y  z",
    "naïve café 東京 は 晴れ 🙂 🙂", "<|endoftext|> and <s> </s> <unk> <0x41>", "mark ▁ inside", "▁", "nul \x00 and \x1f \x7f control", "dash — quote “ x ”",
    "aaaaaaaa " * 50, "=" * 500 + " " + "-" * 300, " ", "  ", "\n", "1234567890 12 345", "don't we'll I've", "plain words, and more words.",
]


def test_odd_texts_nulls_and_repeated_rows(spark, encoders):
    rows = [(k if k != 5 else None, t, "x", 1) for k, t in enumerate(ODD)] + [(0, ODD[0], "x", 1), (0, "another text of the same id", None, None)]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    want = plain([r[1] for r in rows], encoders)
    assert found(token_align.cross_align(df)) == sorted((r[0] if r[0] is not None else -1, w) for r, w in zip(rows, want, strict=True))


def test_empty_table(spark):
    out = token_align.cross_align(spark.createDataFrame([], FIELDS))
    assert out.count() == 0
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_a_small_pool_changes_nothing(monkeypatch):
    texts = pa.array([f"word{k % 7} some text {k} and\tmore" for k in range(60)] + [None, "again word1 and more", "กขฃ" * 40])

    def rows(pool):
        monkeypatch.setattr(token_align, "POOL", pool)
        encoder, hasher, out = token_align.Encoder(token_align.VOCABULARY_A, token_align.VOCABULARY_B), Hasher(), []
        for lo, hi, data, offsets in chunks(texts, 200):
            columns, pair, times, held = token_align.aligned_rows(encoder, hasher, list(range(lo, hi)), data, offsets)
            out.append((columns, pair.tolist(), times.tolist(), held.tolist()))
        return out

    assert rows(5) == rows(100_000)


def test_chunks_and_long_texts(spark, encoders):
    texts = [f"word{k % 7} some text {k} and\tmore" for k in range(60)] + ["long " * 20_000, "กขฃ" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)  # a chunk for each task at least
    assert found(token_align.cross_align(df)) == list(enumerate(plain(texts, encoders)))


@given(st.lists(st.lists(st.tuples(st.integers(0, 1 << 20), st.integers(1, 1000)), max_size=5), max_size=6))
def test_packed_entries_come_back(docs):
    sizes, place, times = (np.array(x, np.int64) for x in ([len(d) for d in docs], [p for d in docs for p, _ in d], [t for d in docs for _, t in d]))
    for x, y in zip(token_align.unpack(token_align.pack(sizes, place, times)), (sizes, place, times), strict=True):
        assert x.tolist() == y.tolist()


def test_long_group_by_counts():
    encoder = token_align.Encoder.__new__(token_align.Encoder)
    encoder.n_b = 10
    a, b = np.array([1, 2] * 50), np.array([3] * 99 + [4])
    one = np.zeros(1, np.int64)
    pair, times, n = encoder._pairs(a, b, one, one, np.array([100]), np.array([100]), one, 1)
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == {13: 4950, 14: 50, 23: 4950, 24: 50}
    assert n.tolist() == [4]


def test_query_on_whole_documents(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    assert found(QUERIES["op13_cross_tokenizer_alignment"](spark, "/root/testdata/sf0.001")) == [(r.doc_id, w) for r, w in zip(rows, plain([r.text for r in rows], encoders), strict=True)]
