"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over the words of a block of texts (one space after each word) give the fingerprint of every n-gram with two look-ups. A shuffle sums fingerprints that tasks have
counted beforehand: first of one and two words, then of longer n-grams whose parts are all frequent, length by length. The frequent fingerprints become a screen, a bit table of bounded size: a false hit only
sends more. Then the texts are read once more: each task checks the occurrences that pass the screen byte by byte against the text that their fingerprint stood for first (one that differs is counted by its
own text), and a second shuffle sums texts, with a pointer to the first document. So counts are exact by text, and only frequent phrases become strings.

A phrase's score is that of its worst cut into two parts, ``floor(1000000 f(phrase)^2 / (f(left) f(right)))``, in decimals of 38 digits (counts up to 10^15).

Defined results: null texts are empty and null languages ``und``; a text without words adds nothing; very long texts are counted whole; each row is a text of its own, so repeated rows count again; ties
go to the smallest cut, then by count and by the bytes of the phrase. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairspan.llm.arrays import Hasher, batch_of, chunks, mixed, release, signed
from pairspan.session import cut_lineage

LEAST = 10  # occurrences of a candidate
WORDS = 3  # longest phrase
SHARE = 50  # per cent of a phrase's occurrences that a longer one must reach to replace it
FIRST = 2000  # phrases of a language in the report
SALT = 8  # copies of the parts' counts, so that a frequent word doesn't gather its phrases in one task
MOST_BITS = 1 << 27  # of the screen: 16 MB at most
GRAMS = 3_000_000  # fingerprints counted together
PHRASES = 600_000  # texts counted together, about 15 bytes each

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[9, 32]] = True
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True


class Words(NamedTuple):
    """Words of a block of texts, one space after each."""

    body: np.ndarray  # their bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    left: np.ndarray  # words from here to the end of the piece, this one included

    def phrases(self, n: int) -> np.ndarray:
        """First words of all phrases of n words."""
        return np.flatnonzero(self.left >= n)


def words_of(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP, breaks: np.ndarray = _BREAK) -> Words:
    """Words of all texts; ``gap`` and ``breaks`` tell which bytes part words and pieces."""
    data = _LOWER[data]
    broken = breaks[data]
    solid = ~(broken | gap[data])
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = np.diff(offsets) > 0
    at = offsets[:-1][filled]
    first[at] = solid[at]
    at = offsets[1:][filled] - 1
    last[at] = solid[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    n = len(start)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(broken)])
    final = np.ones(n, bool)  # last word of its piece
    final[:-1] = (row[1:] != row[:-1]) | (before[start[1:]] != before[end[:-1]])
    ends = np.flatnonzero(final)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
    size = end - start
    stop = np.cumsum(size + 1) - 1
    body = np.full(int(stop[-1]) + 1 if n else 0, 32, np.uint8)
    kept = np.ones(len(body), bool)
    kept[stop] = False
    body[kept] = data[solid]
    return Words(body, stop - size, stop, row, left)


def language_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def fingerprints(hasher: Hasher, words: Words, at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Of the phrases of n words that begin at ``at``; ``keys`` tells the languages of the rows apart. The hasher has loaded the words."""
    return mixed(hasher.spans(words.start[at], words.end[at + n - 1]) + keys[words.row[at]])


class Screen(NamedTuple):
    """Bit table of frequent fingerprints."""

    bits: np.ndarray

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(len(self.bits) * 64 - 1)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def screen_of(frequent: DataFrame, most_bits: int = MOST_BITS) -> Screen:
    """Bits of the fingerprints in column ``fp``: about 16 for each, ``most_bits`` at most. The driver gets one row for each word of 64 bits that isn't zero."""
    size = min(most_bits, max(1 << 12, 1 << (16 * frequent.count()).bit_length()))
    slot = F.col("fp").bitwiseAND(F.lit(size - 1))
    places = frequent.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = places.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    found = rows.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return Screen(bits)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, list[str]]]:
    """Rows, words, language keys of the rows and their languages."""
    for b in batches:
        langs = pc.fill_null(b.column("lang"), "und").to_pylist()
        for lo, hi, data, offsets in chunks(b.column("text")):
            own = langs[lo:hi]
            key = {k: language_key(k) for k in set(own)}
            yield b.slice(lo, hi - lo), words_of(data, offsets), np.array([key[k] for k in own], np.uint64), own


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"))


def frequent_fingerprints(docs: DataFrame, lengths: list[int], screen: Screen | None = None, least: int = LEAST) -> DataFrame:
    """``fp`` of the phrases of these lengths with at least ``least`` occurrences; with a screen, of those whose parts one word shorter pass it. Written to the shared folder."""
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64())])
    held = docs.sparkSession.sparkContext.broadcast(screen) if screen is not None else None

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        fp, n = np.unique(np.concatenate(parts), return_counts=True)
        return batch_of(schema, fp=signed(fp), n=n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, n = Hasher(), [], 0
        for _, words, keys, _ in _blocks(batches):
            hasher.load(words.body)
            for length in lengths:
                at = words.phrases(length)
                if held is not None:
                    both = words.phrases(length - 1)
                    passed = np.zeros(len(words.row), bool)
                    passed[both] = held.value.holds(fingerprints(hasher, words, both, length - 1, keys))
                    at = at[passed[at] & passed[np.minimum(at + 1, len(passed) - 1)]]
                parts.append(fingerprints(hasher, words, at, length, keys))
                n += len(at)
            if n >= GRAMS:
                yield counted(parts)
                parts, n = [], 0
                release()
        if parts:
            yield counted(parts)

    counts = _texts(docs).mapInArrow(scan, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.where(F.col("n") >= least).select("fp"))


class Texts(NamedTuple):
    """Phrases with their texts: fingerprint, occurrences, first document, language and number of words, and where the text stands in ``body``."""

    h: np.ndarray
    f: np.ndarray
    doc: np.ndarray
    lang: np.ndarray
    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    body: np.ndarray


NO_DOC = np.iinfo(np.int64).max  # stands for a null id


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def merged(t: Texts) -> Texts:
    """One row for each text: rows of one fingerprint are compared, byte by byte, with the text of the first; those that differ stay apart."""
    order = np.argsort(t.h, kind="stable")
    h, start, size = t.h[order], t.start[order], t.size[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    same = size == size[head][group]
    other = np.flatnonzero(same & ~first)
    for lo in range(0, len(other), 1 << 16):
        part = other[lo : lo + (1 << 16)]
        n = size[part]
        equal = t.body[_ragged(start[part], n)] == t.body[_ragged(start[head][group[part]], n)]
        if not equal.all():
            same[np.repeat(part, n)[~equal]] = False
    kept = order[np.concatenate([head, np.flatnonzero(~same)])]
    apart = np.flatnonzero(~same)
    f = np.concatenate([np.bincount(group[same], t.f[order][same], len(head)).astype(np.int64), t.f[order][apart]])
    at, n = t.start[kept], t.size[kept]
    return Texts(t.h[kept], f, t.doc[kept], t.lang[kept], t.words[kept], np.cumsum(n) - n, n, t.body[_ragged(at, n)])


def joined(parts: list[Texts]) -> Texts:
    shift = np.cumsum([0, *[len(p.body) for p in parts[:-1]]])
    moved = [p._replace(start=p.start + s) for p, s in zip(parts, shift, strict=True)]
    return Texts(*(np.concatenate(c) for c in zip(*moved, strict=True)))


def phrase_counts(docs: DataFrame, screen: Screen, most_words: int = WORDS) -> DataFrame:
    """``lang, phrase, words, f, first_doc`` of all phrases that pass the screen; a row of empty phrase and 0 words holds a language's number of words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64()), ("doc_id", pa.int64())])
    held = docs.sparkSession.sparkContext.broadcast(screen)

    def rows(parts: list[Texts], names: list[str], sizes: dict[str, int]) -> Iterator[pa.RecordBatch]:
        t = merged(joined(parts))
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(t.size).astype(np.int32)])
        phrase = pa.StringArray.from_buffers(len(t.h), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(t.body)))
        lang = pa.array(names, pa.string()).take(pa.array(t.lang))
        yield batch_of(schema, lang=lang, phrase=phrase, words=t.words.astype(np.int32), f=t.f, doc_id=pa.array(t.doc, mask=t.doc == NO_DOC))
        k = len(sizes)
        yield batch_of(schema, lang=list(sizes), phrase=[""] * k, words=np.zeros(k, np.int32), f=list(sizes.values()), doc_id=[None] * k)
        release()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, n, code, sizes = Hasher(), [], 0, {}, {}
        for b, words, keys, langs in _blocks(batches):
            own = np.array([code.setdefault(k, len(code)) for k in langs], np.int64)
            ids = pc.fill_null(b.column("doc_id"), NO_DOC).to_numpy(zero_copy_only=False)
            hasher.load(words.body)
            met = []
            for length in range(1, most_words + 1):
                at = words.phrases(length)
                h = fingerprints(hasher, words, at, length, keys)
                ok = held.value.holds(h)
                met.append((h[ok], at[ok], np.full(int(ok.sum()), length)))
            h, at, length = (np.concatenate(x) for x in zip(*met, strict=True))
            row, start = words.row[at], words.start[at]
            part = merged(Texts(h, np.ones(len(h), np.int64), ids[row], own[row], length, start, words.end[at + length - 1] - start, words.body))
            parts.append(part)
            n += len(part.h)
            for lang, count in zip(langs, np.bincount(words.row, minlength=len(langs)).tolist(), strict=True):
                sizes[lang] = sizes.get(lang, 0) + count
            if n >= PHRASES:
                yield from rows(parts, list(code), sizes)
                parts, n, sizes = [], 0, {}
        if parts:
            yield from rows(parts, list(code), sizes)

    found = _texts(docs).mapInArrow(scan, "lang string, phrase string, words int, f long, doc_id long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"), F.min("doc_id").alias("first_doc"))


def _salted(parts: DataFrame, side: str) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    return parts.select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(f"f_{side}"), copies.alias("salt"))


def scored(counts: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """Candidates that no longer one replaces: ``lang, phrase, words, a, l, r, score, first_doc``."""
    wide = counts.where((F.col("words") > 1) & (F.col("f") >= least)).withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    cuts = wide.select("lang", "phrase", "f", "w", "words", cut, F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int").alias("salt"))
    sides = cuts.select("lang", "phrase", "f", "k", "salt", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
    parts = counts.where(F.col("words") > 0)
    met = sides.join(_salted(parts, "left"), ["lang", "left", "salt"]).join(_salted(parts, "right"), ["lang", "right", "salt"])
    score = F.expr("(cast(f as decimal(16,0)) * cast(f as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(f_left as decimal(18,0)) * cast(f_right as decimal(18,0)))")
    worst = met.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", F.col("f_left").alias("l"), F.col("f_right").alias("r"))).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = wide.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = wide.drop("w").join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    return kept.join(worst, ["lang", "phrase"]).select("lang", "phrase", "words", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", "first_doc")


def ranked(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """The first rows of each language by score, count and phrase, with their ``rank``.

    Rows are counted by bucket of score (and count, among low scores) first, so that only those of buckets that reach into the report are sorted, each bucket on its own.
    """
    low = F.col("score") < 1000  # most phrases: told apart by score and count
    places = {"bucket": F.when(low, F.col("score")).otherwise(1000 + F.floor(F.col("score") / 50)), "count": F.when(low, F.least("a", F.lit(1000))).otherwise(0)}
    phrases, keys = cut_lineage(phrases.withColumns(places)), ["lang", "bucket", "count"]
    counts = phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    above = F.sum("held").over(Window.partitionBy("lang").orderBy(F.desc("bucket"), F.desc("count"))) - F.col("held")
    reach = counts.select(*keys, above.alias("above")).where(F.col("above") < first)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    near = phrases.join(reach, keys).withColumn("k", F.row_number().over(order)).where(F.col("k") <= first)
    return near.withColumn("rank", F.col("above") + F.col("k")).where(F.col("rank") <= first).drop("bucket", "count", "above", "k")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = WORDS, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """The first phrases of each language of ``docs`` (doc_id, text, lang): ``lang, rank, phrase, a, l, r, n, score, first_doc``."""
    frequent = frequent_fingerprints(docs, [1, 2], None, least)
    for length in range(3, most_words + 1):
        frequent = frequent.union(frequent_fingerprints(docs, [length], screen_of(frequent), least))
    counts = cut_lineage(phrase_counts(docs, screen_of(frequent), most_words).where((F.col("words") == 0) | (F.col("f") >= least)))
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked(scored(counts, least, share), first).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")
