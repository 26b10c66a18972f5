"""Language identification by unigram piece models that sum over all segmentations.

The vocabulary is that of a public tokenizer (its path is a parameter); for each language the fit finds piece probabilities by expectation maximisation over the
words of a bounded number of labelled texts. A word's probability is the sum over every way to cut it into pieces, by a forward pass; words are lower-cased
runs of letters, each with the word mark in front. A text's score is the posterior of its language over all its words.

Every language is fitted, whatever their number: a task fits one language, and a task that scores holds the models of one block of languages.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled row every text is ``und``; an empty table gives no rows; ties go to the first language by name; a word of
more than ``LONGEST`` letters is cut into stretches of that length, and very long texts are scored whole; repeated rows get the same answer and are learned from once. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairspan.llm.arrays import CHUNK_BYTES, Hasher, batch_of
from pairspan.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROWS_PER_LANGUAGE = 300  # labelled texts that a language's model is fitted to
LANGUAGES_TOGETHER = 64  # whose models a task holds at once
SENT_LANGUAGES = 100_000  # names and numbers of so many languages, some MB, are broadcast
LONGEST = 24  # letters handled together
MARK = 0x2581  # the vocabulary's word mark
ROUNDS = 4
UNKNOWN = 1e-7  # probability of a letter that is no piece of the vocabulary
FLOOR = 1e-7  # added to each piece's share before normalising
CACHE_BITS = 18
SLICE = 1 << 16  # words whose forward pass runs together


class Pieces:
    """Pieces of the vocabulary by hash of their code points: two tables of slots, checked by the whole hash. Place 0 is no piece."""

    BITS = 20

    def __init__(self, pieces: list[str]) -> None:
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        self.longest = max((len(p) for p in points), default=1)
        hasher = Hasher()
        hasher.load(np.concatenate(points) if points else np.zeros(0, np.uint32))
        ends = np.cumsum([len(p) for p in points]).astype(np.int64)
        h = hasher.spans(ends - np.array([len(p) for p in points], np.int64), ends)
        self.n = len(pieces) + 1
        self.hashes = np.concatenate([np.zeros(1, np.uint64), h])
        self.one, self.two = (np.zeros(1 << self.BITS, np.int32) for _ in range(2))
        mask = np.uint64((1 << self.BITS) - 1)
        for k, (a, b) in enumerate(zip((h & mask).tolist(), ((h >> np.uint64(24)) & mask).tolist(), strict=True), 1):
            if not self.one[a]:
                self.one[a] = k
            elif not self.two[b]:
                self.two[b] = k
            else:
                raise ValueError("two pieces share both slots; raise BITS")

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.BITS) - 1)
        got = self.one[(h & mask).astype(np.int64)]
        miss = self.hashes[got] != h
        other = self.two[((h[miss] >> np.uint64(24)) & mask).astype(np.int64)]
        got[miss] = np.where(self.hashes[other] == h[miss], other, 0)
        return got


class Model(NamedTuple):
    languages: list[str]
    pieces: Pieces
    probability: np.ndarray  # (piece, language)
    prior: np.ndarray


def read_vocabulary(path: str = VOCABULARY, longest: int = 12) -> list[str]:
    """Pieces of letters, with or without the word mark, of at most ``longest`` code points."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    mark = chr(MARK)
    return sorted({p.lower() for p in found if len(p) <= longest and p.removeprefix(mark).isalpha() or p == mark})


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and start, end and row of each stretch of letters."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    points = np.concatenate([np.zeros(0, np.uint32), *parts])
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    solid = _letters()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = (end - start + LONGEST - 1) // LONGEST
    if len(cuts) and cuts.max() > 1:
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        stop = np.repeat(end, cuts)
        start = np.repeat(start, cuts) + inner * LONGEST
        end = np.minimum(start + LONGEST, stop)
    return points, start, end, np.searchsorted(offsets, start, side="right") - 1


def _grid(points: np.ndarray, start: np.ndarray, size: int, pieces: Pieces, hasher: Hasher) -> np.ndarray:
    """Place of the piece from each letter i over l + 1 letters, for words of one length; the mark is letter 0."""
    n = len(start)
    marked = np.empty((n, size + 1), np.uint32)
    marked[:, 0] = MARK
    marked[:, 1:] = points[start[:, None] + np.arange(size)]
    hasher.load(marked.ravel())
    most = min(pieces.longest, size + 1)
    out = np.zeros((size + 1, most, n), np.int32)
    base = np.arange(n, dtype=np.int64) * (size + 1)
    for i in range(size + 1):
        for l in range(min(most, size + 1 - i)):
            out[i, l] = pieces.find(hasher.spans(base + i, base + i + l + 1))
    return out


def _forward(grid: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each letter: (letter, word, language)."""
    letters, most, n = grid.shape
    alpha = np.zeros((letters + 1, n, probability.shape[1]))
    alpha[0] = 1
    for j in range(1, letters + 1):
        for l in range(min(most, j)):
            ids = grid[j - l - 1, l]
            alpha[j] += alpha[j - l - 1] * probability[ids]
            if l == 0:
                alpha[j] += alpha[j - 1] * np.where(ids == 0, UNKNOWN, 0.0)[:, None]
    return alpha


def _by_length(start: np.ndarray, end: np.ndarray, languages: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    size, step = end - start, max(256, 4 * SLICE // max(4, languages))
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for lo in range(0, len(own), step):
            yield int(n), own[lo : lo + step]


def log_probability(points: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model, hasher: Hasher) -> np.ndarray:
    """log of the sum over segmentations of each word, by language."""
    out = np.zeros((len(start), len(model.languages)))
    for size, own in _by_length(start, end, len(model.languages)):
        out[own] = np.log(_forward(_grid(points, start[own], size, model.pieces, hasher), model.probability)[-1])
    return out


def fit_language(words: dict[str, int], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation maximisation: expected uses of each piece over all segmentations of all words."""
    points, start, end, row = text_words(list(words))
    count = np.array(list(words.values()), float)[row]
    hasher = Hasher()
    grids = [(own, _grid(points, start[own], size, pieces, hasher)) for size, own in _by_length(start, end)]
    p = np.full((pieces.n, 1), 1.0 / pieces.n)
    p[0] = 0
    for _ in range(rounds):
        uses = np.zeros(pieces.n)
        for own, grid in grids:
            letters, most, n = grid.shape
            alpha = _forward(grid, p)[..., 0]
            beta = np.zeros((letters + 1, n))
            beta[letters] = 1
            for i in range(letters - 1, -1, -1):
                for l in range(min(most, letters - i)):
                    ids = grid[i, l]
                    beta[i] += beta[i + l + 1] * p[ids, 0]
                    if l == 0:
                        beta[i] += beta[i + 1] * np.where(ids == 0, UNKNOWN, 0.0)
            share = count[own] / alpha[letters]
            for i in range(letters):
                for l in range(min(most, letters - i)):
                    ids = grid[i, l]
                    uses += np.bincount(ids, share * alpha[i] * p[ids, 0] * beta[i + l + 1], pieces.n)
        uses[0] = 0
        p = (uses / max(uses.sum(), 1e-300) + FLOOR)[:, None]
        p[0] = 0
        p /= p.sum()
    return p[:, 0]


class Fitted(NamedTuple):
    """Models of all languages as rows ``block, lang, prior, rest, ids, p``: pieces that a language uses and the probability of the others."""

    table: DataFrame
    vocabulary: str
    blocks: int


@functools.cache
def _pieces(vocabulary: str) -> Pieces:
    return Pieces(read_vocabulary(vocabulary))


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, rows_per_language: int = ROWS_PER_LANGUAGE, together: int = LANGUAGES_TOGETHER) -> Fitted:
    """Fit every language of ``labelled`` (doc_id, text, lang); rows of null lang are left out.

    A language learns from at most ``rows_per_language`` different rows, in the order of a hash of id and text. Words are counted and languages fitted on Spark, a task for each language.
    """
    draw = F.xxhash64(F.lit("fit"), labelled["doc_id"], labelled["text"])
    known = labelled.select(labelled["text"].alias("text"), labelled["lang"].cast("string").alias("lang"), draw.alias("draw")).where("lang is not null")
    totals = cut_lineage(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    # a row for each language, sent to the texts while there are few enough; else texts meet them by a shuffle, which adaptive execution splits
    sent = F.broadcast if totals.count() <= SENT_LANGUAGES else lambda df: df
    # coarse cut first, so that the exact order is taken over few rows
    share = F.least(F.lit(1.0), 4.0 * (rows_per_language + 25) / F.col("n"))
    near = known.select("lang", "draw").join(sent(totals), "lang").where(F.col("draw") / float(1 << 64) + 0.5 < share).select("lang", "draw").distinct()
    ranked = near.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("draw")).alias("k")).where(F.col("k") <= rows_per_language)
    last = ranked.groupBy("lang").agg(F.max("draw").alias("last"))
    sample = known.join(sent(last), "lang").where("draw <= last").dropDuplicates(["lang", "draw"])
    letters = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)")))
    words = sample.select("lang", letters.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def one(table: pa.Table) -> pa.Table:
        pieces = _pieces(vocabulary)
        held = sorted(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        p = fit_language(dict(held), pieces)
        rest = float(p[1:].min(initial=1.0))
        used = np.flatnonzero(p > rest * (1 + 1e-9))
        return pa.table({
            "lang": pa.array([table["lang"][0].as_py()], pa.string()), "rest": pa.array([rest]),
            "ids": pa.array([used], pa.list_(pa.int32())), "p": pa.array([p[used]], pa.list_(pa.float64())),
        })

    fitted = cut_lineage(words.groupBy("lang").applyInArrow(one, "lang string, rest double, ids array<int>, p array<double>"))
    named = fitted.select("lang").join(totals, "lang")  # a row for each language
    place = F.row_number().over(Window.orderBy("lang")) - 1
    prior = F.log(F.col("n") / F.sum("n").over(Window.partitionBy()))
    placed = named.select("lang", prior.alias("prior"), F.floor(place / together).cast("int").alias("block"))
    table = cut_lineage(fitted.join(placed, "lang").select("block", "lang", "prior", "rest", "ids", "p"))
    return Fitted(table, vocabulary, table.agg(F.count_distinct("block")).first()[0])


def block_model(fitted: Fitted, block: int) -> Model:
    """The models of one block of languages, as a matrix."""
    pieces, rows = _pieces(fitted.vocabulary), fitted.table.where(F.col("block") == block).orderBy("lang").toArrow().to_pylist()
    probability = np.empty((pieces.n, len(rows)))
    for k, r in enumerate(rows):
        probability[:, k] = r["rest"]
        probability[r["ids"], k] = r["p"]
    probability[0] = 0
    return Model([r["lang"] for r in rows], pieces, probability, np.array([r["prior"] for r in rows]))


class _Cache:
    """Scores of words by hash, a slot each: a later word takes the slot of an earlier one, so memory is bounded."""

    def __init__(self, model: Model) -> None:
        self.model, self.hasher = model, Hasher()
        self.bits = min(CACHE_BITS, 23 - len(model.languages).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros((1 << self.bits, len(model.languages)))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log probabilities of each text's words, by language, and its number of words."""
        points, start, end, row = text_words(texts)
        self.hasher.load(points)
        h = self.hasher.spans(start, end)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        value = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            own, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            new = log_probability(points, start[at], end[at], self.model, Hasher())
            value[miss] = new[inverse]
            self.keys[slot[at]], self.values[slot[at]] = own, new
        total = np.stack([np.bincount(row, value[:, k], len(texts)) for k in range(value.shape[1])], axis=1)
        return total, np.bincount(row, minlength=len(texts))


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row, doc_id, letters, lang, best, total``: words of each row, the likeliest language of the block with its log probability, and that of the whole block."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("letters", pa.int64()), ("lang", pa.string()), ("best", pa.float64()), ("total", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model) if model is not None else None
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, side="right")))
                keys = {"row": b.column("row").slice(lo, hi - lo), "doc_id": b.column("doc_id").slice(lo, hi - lo)}
                if cache is None:
                    yield batch_of(schema, **keys, letters=np.zeros(hi - lo, np.int64), lang=["und"] * (hi - lo), best=np.zeros(hi - lo), total=np.zeros(hi - lo))
                else:
                    total, n = cache.scores(texts.slice(lo, hi - lo).to_pylist())
                    total += model.prior
                    best = total.max(1)
                    every = best + np.log(np.exp(total - best[:, None]).sum(1))
                    yield batch_of(schema, **keys, letters=n, lang=[model.languages[k] for k in total.argmax(1).tolist()], best=best, total=every)
                lo = hi

    return docs.mapInArrow(scan, "row long, doc_id long, letters long, lang string, best double, total double")


def predict(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (doc_id, text).

    A task holds the models of one block of languages. With more blocks the texts are written once with a row number and read for each block; the blocks' results, one narrow row for each
    text, are then put together.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if fitted.blocks <= 1:
        model = block_model(fitted, 0) if fitted.blocks else None
        best = _scored(own.withColumn("row", F.lit(0).cast("long")), model).withColumn("every", F.col("total"))
    else:
        rows = cut_lineage(own.withColumn("row", F.monotonically_increasing_id()))
        parts = [cut_lineage(_scored(rows, block_model(fitted, k))) for k in range(fitted.blocks)]
        every = functools.reduce(DataFrame.unionAll, parts)
        likely = F.min(F.struct((-F.col("best")).alias("less"), "lang"))  # of equally likely ones the first by name
        met = every.groupBy("row", "doc_id", "letters").agg(likely.alias("top"), F.collect_list("total").alias("totals"))
        high = F.array_max("totals")
        log_sum = high + F.log(F.aggregate("totals", F.lit(0.0), lambda s, t: s + F.exp(t - high)))
        best = met.select("doc_id", "letters", F.col("top.lang").alias("lang"), (-F.col("top.less")).alias("best"), log_sum.alias("every"))
    some = F.col("letters") > 0
    return best.select("doc_id", F.when(some, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(some, F.exp(F.col("best") - F.col("every"))).otherwise(0.0).alias("score"))


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
