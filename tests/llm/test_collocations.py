"""Phrase collocations against a plain count, and the check of fingerprints against texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairspan.llm import collocations
from pairspan.llm.arrays import Hasher

FIELDS = "doc_id long, text string, lang string, phrase string, n int"


def pieces(text):
    lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, least=10, most=3, share=50, first=2000):
    f, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in pieces(text):
            words[lang or "und"] += len(w)
            for n in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in cands.items():
            longer = max((b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=None)
            if longer is None or 100 * longer < share * a:
                score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                left.append((-score, -a, " ".join(p).encode(), l, r))
        left.sort()
        out += [(lang, k, p.decode(), -a, l, r, words[lang], -s) for k, (s, a, p, l, r) in enumerate(left[:first], 1)]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def texts(n=300):
    rng = np.random.default_rng(5)
    stock = ["the", "of", "New", "york", "City", "é1", "ß", "don't", "a-b", "x"]
    out = []
    for _ in range(n):
        w = [stock[i] for i in rng.integers(0, len(stock), 25)]
        marks = [" ", "  ", "\t", ", ", ". ", "\n", ";", "   "]
        out.append("".join(a + marks[i] for a, i in zip(w, rng.choice(8, 25, p=[0.6, 0.05, 0.05, 0.1, 0.1, 0.04, 0.03, 0.03]), strict=True)))
    return out + ["New York City " * 40, "new york, city\n" * 15]


@pytest.mark.parametrize("least, most, share, first", [(10, 3, 50, 2000), (3, 4, 30, 7), (2, 2, 50, 50)])
def test_equals_a_plain_count(spark, least, most, share, first):
    rows = [(k, t, [None, "en", "de"][k % 3], "x", 1) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    assert found(collocations.collocations(df, least, most, share, first)) == plain([(r[1], r[2]) for r in rows], least, most, share, first)


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "x", 1), (None, " ., !", "en", "x", 1), (None, "a b", "en", "x", 1), *[(7, "a b c", "en", "x", 1)] * 12, (8, "z " * 200_000, "fr", "x", 1)]
    out = found(collocations.collocations(spark.createDataFrame(rows, FIELDS)))
    assert out == plain([(r[1], r[2]) for r in rows])
    assert ("en", 1, "b c", 12, 13, 12, 38, 923076) not in out  # replaced by the phrase of three words


def test_first_occurrence_and_empty_table(spark):
    df = spark.createDataFrame([(k, "p q. x. " * 5 + "p q r", "en", "x", 1) for k in (9, 4, 5)], FIELDS)
    row = [r for r in collocations.collocations(df).collect() if r["phrase"] == "p q"][0]
    assert (row["first_doc"], row["a"]) == (4, 18)
    assert collocations.collocations(spark.createDataFrame([], FIELDS)).count() == 0


def test_shared_fingerprints_are_told_apart_by_text():
    data = np.frombuffer(b"aa bb aa cc bb aa ddd", np.uint8)
    words = collocations.words_of(data, np.array([0, len(data)]))
    none, one = np.zeros(7, np.int64), np.ones(7, np.int64)
    t = collocations.Texts(np.zeros(7, np.uint64), one, none, none, one, words.start, words.end - words.start, words.body)
    first = collocations.merged(t)
    both = collocations.merged(collocations.joined([first, collocations.merged(collocations.joined([first, first]))]))
    for got, times in ((first, 1), (both, 3)):
        counted = Counter()
        for f, s, n in zip(got.f, got.start, got.size, strict=True):
            counted[got.body[s : s + n].tobytes()] += f
        assert counted == {b"aa": 3 * times, b"bb": 2 * times, b"cc": times, b"ddd": times}


def test_ranks_by_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(["en", "de"][k % 5 > 0], f"p{k:04d}", int(rng.integers(10, 14)), int(s)) for k, s in enumerate(rng.choice([0, 49, 50, 51, 1_000_000, 777], 3000))]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    for first in (1, 37, 2000):
        got = sorted(tuple(r[k] for k in ("lang", "rank", "phrase")) for r in collocations.ranked(df, first).collect())
        want = []
        for lang in ("en", "de"):
            own = sorted((-s, -a, p) for g, p, a, s in rows if g == lang)
            want += [(lang, k, p) for k, (_, _, p) in enumerate(own[:first], 1)]
        assert got == sorted(want)


def test_a_full_screen_changes_nothing(spark):
    df = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in enumerate(texts(100))], FIELDS)
    counts = []
    for screen in (None, collocations.Screen(np.full(64, ~np.uint64(0)))):
        frequent = collocations.frequent_fingerprints(df, [1, 2])
        own = screen or collocations.screen_of(frequent)
        three = collocations.frequent_fingerprints(df, [3], own)
        all_ = screen or collocations.screen_of(frequent.union(three))
        counts.append((three.count(), sorted(tuple(r) for r in collocations.phrase_counts(df, all_).where("f >= 10").collect())))
    assert counts[0] == counts[1]


def test_fingerprints_depend_on_words_and_language_only():
    data = np.frombuffer("aa  bb aa\tbb. aa bb".encode(), np.uint8)
    words = collocations.words_of(data, np.array([0, len(data)]))
    hasher = Hasher()
    hasher.load(words.body)
    h = collocations.fingerprints(hasher, words, words.phrases(2), 2, np.array([collocations.language_key("en")], np.uint64))
    assert words.phrases(2).tolist() == [0, 1, 2, 4] and h[0] == h[2] == h[3] != h[1]
    other = collocations.fingerprints(hasher, words, words.phrases(2), 2, np.array([collocations.language_key("de")], np.uint64))
    assert other[0] != h[0]
