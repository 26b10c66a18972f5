"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment scores the pairs.

Words are case-folded runs of letters and digits of Unicode, and single characters in scripts without spaces (as in ``toxicity``). Items are cut into segments, texts into overlapping passages twice as long and more, so that the copy of a segment
lies in one passage whole. A passage meets a segment by the n-grams that both have; each n-gram weighs log(N/df)/log(N) by its count df among the N
n-grams of all texts, so a rare one is enough while common ones must come together. Each pair that meets is aligned: a match scores 2, another word or a gap -1,
and the score is the part of the segment's best possible one.

Defined results: null texts count as empty; an item of fewer than ``N_GRAM`` words is never found; repeated rows of an item or a document give the same pairs once; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import Hasher, batch_of, chunks, mixed
from pairspan.llm.toxicity import _spans
from pairspan.session import cut_lineage

N_GRAM = 3
SEGMENT = 64  # words of a segment of an item
PASSAGE = 160  # words of a passage; the next one starts half of it on
LEAST_WEIGHT = 0.75  # of the seeds of a pair, before it is aligned
LEAST_SCORE = 0.5
MATCH, OTHER, GAP = 2, -1, -1
BITS = 22  # of the table of n-grams that items have: its size is fixed
_STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _tokens(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, start, end, row = _spans(data, offsets)
    hasher.load(low)
    return hasher.spans(start, end), row


def grams(token: np.ndarray) -> np.ndarray:
    """Hash of the n-gram from each word on; the last words have none."""
    n = max(0, len(token) - N_GRAM + 1)
    total = np.zeros(n, np.uint64)
    for k in range(N_GRAM):
        total += token[k : k + n] * _STEPS[k]
    return mixed(total)


def segments(items: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``item_id, segment, tokens`` (packed hashes), half overlapping when an item is longer than ``size`` words."""
    schema = pa.schema([("item_id", pa.int64()), ("segment", pa.int64()), ("tokens", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("text")):
                token, row = _tokens(data, offsets, hasher)
                ids, no, packed = [], [], []
                for r, own in enumerate(np.split(token, np.searchsorted(row, np.arange(1, hi - lo)))):
                    if len(own) < N_GRAM:
                        continue
                    for k, at in enumerate(range(0, max(1, len(own) - size // 2), size // 2)):
                        ids.append(b.column("item_id")[lo + r].as_py())
                        no.append(k)
                        packed.append(own[at : at + size].tobytes())
                yield batch_of(schema, item_id=ids, segment=no, tokens=packed)

    rows = items.select(items["item_id"].alias("item_id"), items["text"].alias("text")).where("item_id is not null")
    return rows.mapInArrow(cut, "item_id long, segment long, tokens binary").distinct()


def _unpacked(tokens: pa.Array) -> Iterator[np.ndarray]:
    for t in tokens:
        yield np.frombuffer(t.as_py(), np.uint64)


def seeds(cut: DataFrame) -> DataFrame:
    """``gram, item_id, segment``, distinct."""
    schema = pa.schema([("gram", pa.int64()), ("item_id", pa.int64()), ("segment", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(grams(t)) for t in _unpacked(b.column("tokens"))]
            n = [len(x) for x in own]
            each = lambda c: np.repeat(b.column(c).to_numpy(zero_copy_only=False), n)
            yield batch_of(schema, gram=np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64), item_id=each("item_id"), segment=each("segment"))

    return cut.mapInArrow(expand, "gram long, item_id long, segment long")


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _table(seeded: DataFrame) -> np.ndarray:
    """Packed bits of the slots that n-grams of items have: 2^22 bits, however many items there are."""
    slot = F.shiftrightunsigned("gram", 64 - BITS)
    own = seeded.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.collect_set(slot.bitwiseAND(F.lit(31)).cast("int")).alias("bits"))
    table = np.zeros(1 << BITS, bool)
    for r in own.toLocalIterator():
        table[np.array(r["bits"]) + (r["w"] << 5)] = True
    return np.packbits(table)


def _scan(docs: DataFrame, packed: np.ndarray, passage: int) -> DataFrame:
    """``doc_id, passage, tokens, grams``: passages with an n-gram whose slot items have; and one row per task, of null id, whose ``passage`` is its number of n-grams."""
    schema = pa.schema([("doc_id", pa.int64()), ("passage", pa.int64()), ("tokens", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher, seen = np.unpackbits(packed).astype(bool), Hasher(), 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(b.column("text")):
                token, row = _tokens(data, offsets, hasher)
                if len(token) < N_GRAM:
                    continue
                gram = grams(token)
                inside = row[: len(gram)] == row[N_GRAM - 1 :]
                seen += int(inside.sum())
                hit = np.flatnonzero(inside & table[_slots(gram)])
                if not len(hit):
                    continue
                first = np.searchsorted(row, np.arange(hi - lo))  # first word of each row
                size = np.bincount(row, minlength=hi - lo)
                step = passage // 2
                r, at = row[hit], hit - first[row[hit]]
                # passages k with k*step <= at and at + N_GRAM <= k*step + passage, that exist
                last = np.maximum(0, -(-np.maximum(0, size[r] - passage) // step))
                k1 = np.minimum(at // step, last)
                k0 = np.maximum(0, k1 - 1)
                both = (k0 < k1) & (at + N_GRAM <= k0 * step + passage)
                rr, kk, hh = np.concatenate([r, r[both]]), np.concatenate([k1, k0[both]]), np.concatenate([hit, hit[both]])
                order = np.lexsort((hh, kk, rr))
                rr, kk, hh = rr[order], kk[order], hh[order]
                new = np.flatnonzero(np.concatenate([[True], (rr[1:] != rr[:-1]) | (kk[1:] != kk[:-1])]))
                cols: dict[str, list] = {"doc_id": [], "passage": [], "tokens": [], "grams": []}
                for a, z in zip(new, [*new[1:], len(rr)], strict=True):
                    if ids[lo + rr[a]] is None:
                        continue
                    begin = first[rr[a]] + kk[a] * step
                    end = min(begin + passage, first[rr[a]] + size[rr[a]])
                    cols["doc_id"].append(ids[lo + rr[a]])
                    cols["passage"].append(int(kk[a]))
                    cols["tokens"].append(token[begin:end].tobytes())
                    cols["grams"].append(gram[hh[a:z]].view(np.int64).tolist())
                yield batch_of(schema, **cols)
        yield batch_of(schema, doc_id=[None], passage=[seen], tokens=[None], grams=[None])

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(scan, "doc_id long, passage long, tokens binary, grams array<long>")


def align(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of pairs: rows of x (pair, segment words) against rows of y (pair, passage words); zeros pad both and match nothing."""
    best = np.zeros(len(x), np.int32)
    h = np.zeros((len(x), y.shape[1] + 1), np.int32)
    slope = np.arange(y.shape[1] + 1, dtype=np.int32) * GAP
    for i in range(x.shape[1]):
        own = x[:, i : i + 1]
        step = np.where((own == y) & (own != 0), MATCH, OTHER).astype(np.int32)
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        h = np.maximum.accumulate(new - slope, axis=1) + slope  # gaps along the passage
        best = np.maximum(best, h.max(1))
    return best


def _aligned(pairs: DataFrame, least: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                xs, ys = list(_unpacked(b.column("item_tokens"))), list(_unpacked(b.column("tokens")))
                x, y = (np.zeros((len(v), max(map(len, v))), np.uint64) for v in (xs, ys))
                for k, (p, q) in enumerate(zip(xs, ys, strict=True)):
                    x[k, : len(p)], y[k, : len(q)] = p, q
                score = align(x, y) / (MATCH * np.array([len(p) for p in xs]))
                ok = pa.array(score >= least)
                yield batch_of(schema, doc_id=b.column("doc_id").filter(ok), item_id=b.column("item_id").filter(ok), score=score[score >= least])

    return pairs.mapInArrow(run, "doc_id long, item_id long, score double")


def contamination(
    docs: DataFrame, items: DataFrame, segment: int = SEGMENT, least_weight: float = LEAST_WEIGHT, least_score: float = LEAST_SCORE,
) -> DataFrame:
    """``doc_id, item_id, score``: the pairs of documents (doc_id, text) and items (item_id, text) whose best alignment reaches ``least_score``."""
    passage = segment * 5 // 2
    cut = cut_lineage(segments(items, segment))
    seeded = cut_lineage(seeds(cut))
    found = cut_lineage(_scan(docs, _table(seeded.select("gram").distinct()), passage).withColumn("body", F.xxhash64("tokens")))
    total = max(2, found.where("doc_id is null").agg(F.sum("passage")).first()[0] or 0)
    hits = found.where("doc_id is not null").select("doc_id", "passage", "body", F.explode("grams").alias("gram"))
    real = hits.join(seeded.select("gram").distinct(), "gram", "left_semi")
    # a gram of two overlapping passages counts twice, which makes it no rarer
    weight = F.greatest(F.lit(0.0), 1 - F.log(F.col("df").cast("double")) / F.log(F.lit(float(total))))
    rarity = real.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).select("gram", weight.alias("weight"))
    rare = cut_lineage(seeded.join(rarity, "gram"))
    met = hits.distinct().join(rare, "gram").groupBy("doc_id", "passage", "body", "item_id", "segment").agg(F.sum("weight").alias("weight"))
    met = met.where(F.col("weight") >= least_weight).select("doc_id", "passage", "body", "item_id", "segment")
    passages = found.where("doc_id is not null").select("doc_id", "passage", "body", "tokens").dropDuplicates(["doc_id", "passage", "body"])
    pairs = met.join(passages, ["doc_id", "passage", "body"])
    pairs = pairs.join(cut.select("item_id", "segment", F.col("tokens").alias("item_tokens")), ["item_id", "segment"])
    return _aligned(pairs, least_score).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no item; rows without an id stay, as they can't be named."""
    bad = contamination(docs, items, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
