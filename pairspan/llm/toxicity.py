"""Toxicity by a linear classifier whose fit penalises score changes when identity terms are swapped.

Words are case-folded runs of letters and digits of Unicode; scripts without spaces are cut into characters. Features of a text are the distinct words, word beginnings
and word endings that it has, as 64-bit hashes. The fit uses a bounded, documented number
of labelled rows; features are picked by how far their class shares lie apart; rows of a class count in the loss as often as all labelled rows stand against the sampled ones, so scores follow the true share of
toxic rows at every size of the table. Weights come from logistic loss with L1, L2 and a counterfactual
term: for each labelled sentence that names a group, the squared change of its score when another group of the same list takes the place. Words that name groups are
always among the features, so that the penalty acts on them.

Defined results: null counts as empty; an empty text gets the score of a text without features; without any toxic or any clean row to learn from every score is 0; labels
that are null are not used; repeated rows get the same score. Only the text is ever scored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import Hasher, batch_of, chunks, mixed
from pairspan.session import cut_lineage

MAX_FIT_ROWS = 6000  # labelled rows used for the fit: up to a third toxic, the rest clean
MAX_FEATURES = 8192
LEAST_ROWS = 4  # of the fitted rows that hold a feature
L1, L2, COUNTERFACTUAL = 2e-4, 1e-4, 1.0
STEPS = 400

#: Names of groups by language; a term is swapped with the others of its list. A parameter of the fit.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist", "buddhist"), ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "trans"),
    ("immigrants", "natives", "refugees", "foreigners"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

#: Scripts written without spaces between words: each character is a word there, with the marks that follow it.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
NONE, LETTER, MARK, SINGLE = range(4)  # kinds of code points

#: (kind, letters from the start or, if negative, from the end); a word of no more letters has no such feature.
AFFIXES = ((1, 5), (2, 7), (3, -5))
_SALT = [mixed(np.array([k + 1], np.uint64))[0] for k in range(8)]


class Model(NamedTuple):
    hashes: np.ndarray  # sorted uint64
    weights: np.ndarray
    bias: float


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Kind and folded form of each code point, and the forms of more than one."""
    kind, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    longer = {}
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            kind[i] = LETTER
            if (low := c.casefold()) != c:
                fold[i] = ord(low[0])
                if len(low) > 1:
                    longer[i] = [ord(x) for x in low]
        elif unicodedata.category(c)[0] == "M":
            kind[i] = MARK
    for lo, hi in UNSPACED:
        own = kind[lo : hi + 1]
        own[own == LETTER] = SINGLE
    return kind, fold, longer


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the rows in them; broken characters become U+FFFD."""
    if not len(data) or data.max() < 128:
        return data, offsets
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    points = data[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for least, most, tail in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xFF, 3)):
        own = np.flatnonzero((points >= least) & (points <= most) & (points == data[at]))
        if not len(own):
            continue
        value, whole = points[own] & (0x3F >> tail), np.ones(len(own), bool)
        for k in range(1, tail + 1):
            byte = padded[at[own] + k]
            whole &= (byte & 0xC0) == 0x80
            value = (value << 6) | (byte & 0x3F)
        points[own] = np.where(whole & (value < 0x110000), value, 0xFFFD)
    return points, np.concatenate([[0], np.cumsum(begins)])[offsets]


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Case-folded code points, and start, end and row of each word: a run of letters and digits of Unicode with their marks, or one character of an unspaced script."""
    kinds, fold, longer = _tables()
    points, offsets = _points(data, offsets)
    low = fold[points]
    if len(points) and points.max() >= 128:
        many = np.flatnonzero(np.isin(points, list(longer)))
        if len(many):
            forms = [longer[p] for p in points[many].tolist()]
            size = np.ones(len(points), np.int64)
            size[many] = [len(f) for f in forms]
            ends = np.concatenate([[0], np.cumsum(size)])
            low, offsets = np.repeat(low, size), ends[offsets]
            low[np.repeat(ends[many], size[many]) + np.concatenate([np.arange(len(f)) for f in forms])] = np.concatenate(forms)
    kind = kinds[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    fresh = kind != MARK
    if not fresh.all():  # a mark is of the kind of the character before it, in the same row
        own = np.maximum.accumulate(np.where(fresh | edge[:-1], np.arange(len(low)), 0))
        kind = np.where(fresh, kind, np.where(fresh[own], kind[own], NONE))
    solid = kind != NONE
    first = solid & fresh
    first[1:] &= (kind[:-1] != LETTER) | (kind[1:] == SINGLE) | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, start, end, np.searchsorted(offsets, start, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every feature, a kind at a time; not yet distinct."""
    if not len(data):
        return
    low, start, end, row = _spans(data, offsets)
    if not len(start):
        return
    hasher.load(low)
    yield row, hasher.spans(start, end) ^ _SALT[0]
    for kind, size in AFFIXES:
        long = np.flatnonzero(end - start > abs(size))
        a, b = (start[long], start[long] + size) if size > 0 else (end[long] + size, end[long])
        yield row[long], hasher.spans(a, b) ^ _SALT[kind]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class Picker:
    """Places of picked hashes: a bit table first, then a search among the few that pass."""

    BITS = 22

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of h that are picked, and their places in ``hashes``."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        place = np.searchsorted(self.hashes, h[at])
        place[place == len(self.hashes)] = 0
        ok = self.hashes[place] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[ok], place[ok]


def _picked(texts: pa.Array, picker: Picker, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row in the chunk, place of the feature), distinct by row and place."""
    for lo, hi, data, offsets in chunks(texts):
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, h in features(data, offsets, hasher):
            at, place = picker.find(h)
            rows.append(row[at])
            places.append(place)
        pair = np.unique(np.concatenate(rows) * len(picker.hashes) + np.concatenate(places)) if len(picker.hashes) else np.zeros(0, np.int64)
        yield lo, hi, pair // max(1, len(picker.hashes)), pair % max(1, len(picker.hashes))


def _term_hash(term: str) -> int:
    hasher, data = Hasher(), np.frombuffer(term.encode(), np.uint8)
    return int(next(iter(features(data, np.array([0, len(data)]), hasher)))[1][0])


def swapped_sentences(text: str, lists: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(sentence, sentence with one group named instead of another) for each sentence that names a group."""
    other = {t: g[(k + 1) % len(g)] for g in lists for k, t in enumerate(g) if len(g) > 1}
    if not other:
        return []
    names = re.compile(r"(?i)(?<!\w)(" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")(?!\w)")
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        if names.search(sentence):
            out.append((sentence, names.sub(lambda m: other[m[0].lower()], sentence)))
    return out


def usable_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``d, toxic, n``: one row for each labelled id of ``docs`` and its number of rows there. Labels of other documents are left out before anything is sampled."""
    known = labels.where("toxic IN (0, 1)").select(labels["doc_id"].alias("d"), labels["toxic"].cast("int").alias("toxic")).groupBy("d").agg(F.max("toxic").alias("toxic"))
    met = docs.select(docs["doc_id"].alias("doc_id")).join(known, F.col("doc_id") == F.col("d"))
    return met.groupBy("d").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))


def sample_labelled(docs: DataFrame, usable: DataFrame, max_rows: int) -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled ids, up to a third of them toxic, by order of an md5 of the id."""
    order = F.md5(F.concat(F.lit("fit"), F.col("d").cast("string")))
    parts = [usable.where(F.col("toxic") == k).orderBy(order, "d").limit(n) for k, n in ((1, max_rows // 3), (0, max_rows - max_rows // 3))]
    picked = parts[0].unionAll(parts[1]).select("d", "toxic")
    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(picked, F.col("doc_id") == F.col("d")).select("text", "toxic")


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Learn from rows of ``labels`` (doc_id, toxic) and the texts of ``docs``. Counting and matching features run on Spark; only picked features of the sampled rows come back."""
    usable = cut_lineage(usable_labels(docs, labels))
    sample = cut_lineage(sample_labelled(docs, usable, max_rows))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    if not n1 or not n0:
        return none
    counted = pa.schema([("h", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in chunks(b.column("text")):
                for row, h in features(data, offsets, hasher):
                    row, h = _distinct(row, h)
                    own, inverse = np.unique(h, return_inverse=True)
                    bad = np.bincount(inverse, toxic[lo + row], len(own)).astype(np.int64)
                    yield batch_of(counted, h=own.view(np.int64), n0=np.bincount(inverse, minlength=len(own)) - bad, n1=bad)

    counts = sample.mapInArrow(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share1, share0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    apart = F.abs(F.log(share1 / share0)) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST_ROWS).orderBy(apart.desc(), "h").limit(MAX_FEATURES).select("h")
    hashes = np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64)
    hashes = np.unique(np.concatenate([hashes, np.array([_term_hash(t) for g in terms for t in g], np.uint64)]))
    picker = Picker(hashes)
    kept = pa.schema([("toxic", pa.int32()), ("on", pa.list_(pa.int64())), ("plus", pa.list_(pa.int64())), ("minus", pa.list_(pa.int64()))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        lists_of = lambda texts: [p.tolist() for lo, hi, row, place in _picked(pa.array(texts), picker, hasher) for p in np.split(place, np.searchsorted(row, np.arange(1, hi - lo)))]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            on = lists_of(texts)
            yield batch_of(kept, toxic=b.column("toxic"), on=on, plus=[None] * len(on), minus=[None] * len(on))
            swaps = [x for t in texts for x in swapped_sentences(t, terms)]
            if swaps:
                before, after = lists_of([s for s, _ in swaps]), lists_of([s for _, s in swaps])
                yield batch_of(kept, toxic=[None] * len(swaps), on=[None] * len(swaps), plus=after, minus=before)

    got = sample.mapInArrow(match, "toxic int, `on` array<long>, plus array<long>, minus array<long>").toArrow().to_pylist()
    rows = sorted((r["toxic"], r["on"]) for r in got if r["toxic"] is not None)
    swaps = sorted((r["plus"], r["minus"]) for r in got if r["toxic"] is None)
    y = np.array([t for t, _ in rows], float)
    every = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    each = np.where(y > 0, every[1] / n1, every[0] / n0)
    return Model(hashes, *_solve(y, each / each.mean(), [o for _, o in rows], swaps, len(hashes), counterfactual))


def _solve(
    y: np.ndarray, each: np.ndarray, on: list[list[int]], swaps: list[tuple[list[int], list[int]]], n_features: int, counterfactual: float,
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps; row k counts ``each[k]`` times, 1 on average."""
    row = np.repeat(np.arange(len(on)), [len(o) for o in on])
    col = np.concatenate([np.array(o, np.int64) for o in on]) if len(row) else np.zeros(0, np.int64)
    pair = np.concatenate([np.full(len(p) + len(m), k) for k, (p, m) in enumerate(swaps)]) if swaps else np.zeros(0, np.int64)
    pcol = np.array([c for p, m in swaps for c in [*p, *m]], np.int64)
    sign = np.array([s for p, m in swaps for s in [1.0] * len(p) + [-1.0] * len(m)])
    w, b, n = np.zeros(n_features), float(np.log((each * y).sum() / (each * (1 - y)).sum())), len(y)
    v, vb, t, rate = w.copy(), b, 1.0, 1.0

    def loss_grad(w, b):
        z = np.bincount(row, w[col], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = np.mean(each * (np.logaddexp(0, z) - y * z)) + L2 / 2 * (w @ w)
        g = np.bincount(col, (each * (p - y) / n)[row], n_features) + L2 * w
        if swaps:
            change = np.bincount(pair, sign * w[pcol], len(swaps))
            loss += counterfactual / 2 * np.mean(change**2)
            g += counterfactual * np.bincount(pcol, sign * change[pair] / len(swaps), n_features)
        return loss, g, float(np.mean(each * (p - y)))

    for _ in range(STEPS):
        loss, g, gb = loss_grad(v, vb)
        while True:
            nw = v - rate * g
            nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * L1)
            nb = vb - rate * gb
            step, stepb = nw - v, nb - vb
            if loss_grad(nw, nb)[0] <= loss + g @ step + gb * stepb + (step @ step + stepb**2) / (2 * rate) + 1e-12:
                break
            rate /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
        rate *= 1.1
    return w, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) for every row of ``docs``; the model is a few thousand numbers."""
    used = np.flatnonzero(model.weights)
    small = Model(model.hashes[used], model.weights[used], model.bias)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, picker = Hasher(), Picker(small.hashes)
        for b in batches:
            z = np.full(b.num_rows, small.bias)
            for lo, hi, row, place in _picked(b.column("text"), picker, hasher):
                if len(row):
                    z[lo:hi] += np.bincount(row, small.weights[place], hi - lo)
            with np.errstate(over="ignore"):
                yield batch_of(schema, doc_id=b.column("doc_id"), score=1 / (1 + np.exp(-z)))

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(scan, "doc_id long, score double")


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose own text scores below ``limit``. Learns as ``op5`` does, without the held-out fold."""
    model = fit(docs.where(~held_out(docs["doc_id"])), labels)
    used = np.flatnonzero(model.weights)
    small = Model(model.hashes[used], model.weights[used], model.bias)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, picker = Hasher(), Picker(small.hashes)
        for b in batches:
            z = np.full(b.num_rows, small.bias)
            for lo, hi, row, place in _picked(b.column(at), picker, hasher):
                if len(row):
                    z[lo:hi] += np.bincount(row, small.weights[place], hi - lo)
            with np.errstate(over="ignore"):
                yield b.filter(pa.array(1 / (1 + np.exp(-z)) < limit))

    plain = docs.toDF(*names)
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
