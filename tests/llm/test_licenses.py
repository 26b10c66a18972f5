"""License notices against a search that tries every stretch of words, and spans against edit distances."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pairspan.llm import licenses
from pairspan.llm.queries import QUERIES

FIELDS = "doc_id long, text string, label string, n_words int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def apart(a, b, most):
    """Whether the letters alone rule out a distance of at most ``most``."""
    x, y = Counter(a), Counter(b)
    return (x - y).total() > most or (y - x).total() > most


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text):
    """(n_words, n_base, first, last, base labels, labels, score) by trying all stretches of words."""
    w = words(text)
    base = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in base}, 1.0 if base else 0.0
    for label, notice, errors in licenses.NOTICES:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                s = " ".join(w[i:j])
                if len(s) > len(notice) + errors:
                    break
                if len(s) >= len(notice) - errors and not apart(s, notice, errors) and (e := distance(s, notice)) <= errors:
                    labels.add(label)
                    score = max(score, 1 - e / len(notice))
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), pytest.approx(score)


def columns(r):
    return tuple(r[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def changed(rng, notice, n):
    s = list(notice)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcxyz ")
        elif kind == 1:
            s.insert(at, rng.choice("abcxyz "))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def texts():
    rng = random.Random(3)
    out = [
        None, "", " .,- ", "MIT License", "mit. LICENSE! mit license", "permit license", "mit licenses", "The MIT-License", "cc by cc by", "cc by-nc 4.0", "ccby", "gnu general public", "é mit license é",
        "Licensed under the Apache Licence, Version 2.0", "gnu\tgeneral\nPublic licence", "apache license" * 3, "GNU Lesser General Public License", "all right reserved", "x" * 3000 + " mit license", "mit license" + "y" * 50,
        "Redistribution and use in source or binary forms, with or without modification, are permitted.",
    ]
    for _, notice, errors in licenses.NOTICES:
        for n in range(errors + 2):
            out.append(f"{rng.choice(['so', 'it is', ''])} {changed(rng, notice, n)} {rng.choice(['and more', 'x', ''])}")
    out.append(" and ".join(changed(rng, n, 1) for _, n, _ in licenses.NOTICES))
    return out


def test_equals_trying_all_stretches(spark):
    rows = [(k if k != 4 else None, t, "x", 9) for k, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, FIELDS).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, t, _, _ in rows:
        assert columns(got[k]) == plain(t), t


def test_spans_tell_errors_and_places(spark):
    rows = list(enumerate(t or "" for t in texts()))
    n = 0
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, w = rows[r["doc_id"]][1], words(rows[r["doc_id"]][1])
        for m in r["matches"]:
            n += 1
            assert distance(" ".join(w[m["first_word"] : m["last_word"] + 1]), m["notice"]) == m["errors"]
            assert words(text[m["start"] : m["stop"]]) == w[m["first_word"] : m["last_word"] + 1]
    assert n > 60


def test_repeated_rows_long_text_and_empty_table(spark):
    long = "word " * 200_000 + "Released under the MIT Licence. " + "tail " * 100_000
    rows = [(1, "mit license"), (1, "mit license"), (1, "other"), (2, long)]
    got = sorted((r["doc_id"], r["labels"], r["n_words"], r["matches"][0]["first_word"] if r["matches"] else None) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "", 1, None), (1, "mit", 2, 0), (1, "mit", 2, 0), (2, "mit", 300_005, 200_003)]
    assert licenses.scan(spark.createDataFrame([], FIELDS)).count() == 0


def test_pieces_cover_the_notice():
    for _, notice, errors in licenses.NOTICES:
        p = licenses.pieces(notice, errors)
        assert "".join(x for _, x in p) == notice and len(p) == errors + 1 and all(notice[a : a + len(x)] == x for a, x in p)


def test_query_equals_trying_all_stretches(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op12_license_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    near = [r for r in got if r["labels"]]
    for r in near + [r for r in got if not r["labels"] and r["n_words"] < 400][:40]:
        if r["n_words"] < 3000:
            assert columns(r) == plain(docs[r["doc_id"]])
    assert near
