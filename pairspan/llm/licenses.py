"""License notices by fuzzy search: exact seeds, then matching with bounded errors.

A text becomes its lower-cased words with one space between them. A notice of which k errors are allowed is split into k + 1 pieces; wherever the notice stands with at most k errors (letters changed, put in or left
out), one of its pieces stands unchanged, so an Aho-Corasick automaton over all pieces finds every candidate place. Around each, the ``regex`` library looks for the best match with at
most k errors that begins and ends with whole words. Matches of one notice that overlap are one place, that of the fewest errors (then the first, then the shortest).

Base places are where the words of a base phrase stand consecutively, unchanged; their labels always stay. A text's score is the best share of a notice's letters that stand right: 1 for a
base place or a match without errors, 0 without any label.

Defined results: null and empty texts, and texts without words, have no places and score 0; very long texts are searched whole; places and labels of ties all count; each row gets its own answer, so repeated rows come
back each. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairspan.llm.arrays import batch_of, chunks
from pairspan.llm.collocations import words_of

# Phrases of the contract and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, short notice and the errors allowed in it.
NOTICES = (
    ("agpl", "gnu affero general public license", 3),
    ("all-rights-reserved", "all rights reserved", 2),
    ("apache", "apache license", 1),
    ("apache-2.0", "apache license version 2 0", 2),
    ("apache-2.0", "licensed under the apache license version 2 0", 5),
    ("bsd", "bsd license", 1),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 9),
    ("cc-by", "creative commons attribution", 3),
    ("cc-by-nc", "cc by nc", 0),
    ("cc-by-nc", "creative commons attribution noncommercial", 4),
    ("cc-by-nd", "cc by nd", 0),
    ("cc-by-sa", "cc by sa", 0),
    ("cc-by-sa", "creative commons attribution sharealike", 4),
    ("cc0", "creative commons zero", 2),
    ("epl", "eclipse public license", 2),
    ("gpl", "gnu general public license", 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 8),
    ("lgpl", "gnu lesser general public license", 3),
    ("mit", "mit license", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 8),
    ("mpl", "mozilla public license", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", 7),
)

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_NO_BREAK = np.zeros(256, bool)
_LOWER = {k: k + 32 for k in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

MATCH = pa.struct([("label", pa.string()), ("notice", pa.string()), ("errors", pa.int32()), *[(k, pa.int64()) for k in ("first_word", "last_word", "start", "stop")]])
MATCH_DDL = "array<struct<label:string,notice:string,errors:int,first_word:long,last_word:long,start:long,stop:long>>"
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(MATCH)),
])


class Notice(NamedTuple):
    label: str
    text: str
    errors: int


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """Place and text of errors + 1 pieces of about the same length."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """Places of notices in normalised texts."""

    def __init__(self, notices: tuple[tuple[str, str, int], ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> None:
        import ahocorasick
        import regex

        self.notices, self.base = [Notice(*n) for n in notices], base
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            if n.errors >= len(n.text):
                raise ValueError(f"as many errors as letters: {n.text}")
            for at, piece in pieces(n.text, n.errors):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if seeds:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?=[^ \0])(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}(?<=[^ \0])(?![^ ])") for n in self.notices]

    def base_places(self, body: str) -> list[tuple[int, str]]:
        """Start and label of every place of a base phrase; ``body`` has a space before and after every word."""
        found = []
        for phrase, label in self.base:
            at = body.find(f" {phrase} ")
            while at >= 0:
                found.append((at + 1, label))
                at = body.find(f" {phrase} ", at + 1)
        return found

    def places(self, body: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of every place of a notice."""
        starts: dict[tuple[int, int], None] = {}
        if self.notices:
            for last, (size, uses) in self.seeds.iter(body):
                for k, at in uses:
                    starts[k, last + 1 - size - at] = None
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, start in starts:
            n = self.notices[k]
            # a match that holds the seed begins at most ``errors`` letters away; with one more to see its neighbours
            lo, hi = max(0, start - n.errors - 1), min(len(body), start + len(n.text) + n.errors + 1)
            left = "\0" if lo and body[lo - 1] != " " else ""
            right = "\0" if hi < len(body) and body[hi] != " " else ""
            m = self.patterns[k].search(left + body[lo:hi] + right)
            if m:
                shift = lo - len(left)
                found.setdefault(k, []).append((m.start() + shift, m.end() + shift, sum(m.fuzzy_counts)))
        out = []
        for k, spans in sorted(found.items()):
            spans = sorted(set(spans))
            while spans:
                reach, group = spans[0][1], []
                while spans and spans[0][0] < reach:
                    reach = max(reach, spans[0][1])
                    group.append(spans.pop(0))
                start, end, errors = min(group, key=lambda s: (s[2], s[0], s[1]))
                out.append((k, start, end, errors))
        return out


def document(finder: Finder, text: pa.StringScalar, body: str) -> dict:
    """Columns of one document; ``body`` holds its words with one space around each."""
    base, places = finder.base_places(body), finder.places(body)
    if not base and not places:
        return {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "matches": []}
    word = [body.count(" ", 0, at) - 1 for at, _ in base]
    spans = [m.span() for m in _WORD.finditer((text.as_py() or "").translate(_LOWER))]
    matches, score = [], 1.0 if base else 0.0
    for k, start, end, errors in places:
        n = finder.notices[k]
        first, last = body.count(" ", 0, start) - 1, body.count(" ", 0, end) - 1
        matches.append({"label": n.label, "notice": n.text, "errors": errors, "first_word": first, "last_word": last, "start": spans[first][0], "stop": spans[last][1]})
        score = max(score, 1 - errors / len(n.text))
    base_labels = {label for _, label in base}
    return {
        "n_base": len(base), "first_word": min(word, default=None), "last_word": max(word, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {m["label"] for m in matches})), "score": score, "matches": matches,
    }


def scan(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` for every row of ``docs`` (doc_id, text).

    A match tells its notice, the errors, its first and last word, and where in the text it starts and stops (code points).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices, base)
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("text")):
                words = words_of(data, offsets, _GAP, _NO_BREAK)
                n_words = np.bincount(words.row, minlength=hi - lo)
                ends = np.concatenate([np.zeros(1, np.int64), words.end + 1])[np.concatenate([np.zeros(1, np.int64), np.cumsum(n_words)])].tolist()
                body, texts = words.body.tobytes(), b.column("text").slice(lo, hi - lo)
                rows = [document(finder, texts[k], " " + body[s:e].decode()) for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False))]
                columns = {f: [r[f] for r in rows] for f in _OUT.names[2:]}
                yield batch_of(_OUT, doc_id=b.column("doc_id").slice(lo, hi - lo), n_words=n_words, **columns)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return own.mapInArrow(
        run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCH_DDL}"
    )
