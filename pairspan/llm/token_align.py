"""Alignment of two tokenizers on the same texts by diagonal run skipping.

Both vocabularies are public files (their paths are parameters). Each text is encoded by both, the byte offsets where tokens of both end cut them into groups, and every pair of
tokens in a group is a link. ``align`` walks the two arrays of end offsets: at the current index shift it compares slices of doubling width, so that a stretch of one-to-one
groups is jumped at once; where the arrays part, it goes on token by token until both end together again, and the shift is updated.

Texts are cut before single spaces that follow a solid character. Neither tokenizer joins across such a place (the first by its pattern; for the second, no piece of the
vocabulary goes on with its space mark after another character, which is checked), so a stretch that occurs often is encoded and aligned once. Stretches are told apart by a 64-bit hash
and their length. A stretch without spaces is one unit of work, whatever its length.

How many documents hold a pair is summed on Spark over pre-aggregated rows, one for each pair of a chunk of documents; the documents' own pairs stay packed with their chunk in the
shared folder, so neither a frequent pair nor a long document goes to one task.

Defined results: null and empty texts, and texts whose joined token bytes differ from space + text for either tokenizer, have no tokens: zeros and an empty digest. Very long texts are encoded
whole. Each row is a document of its own: repeated rows (and rows of repeated or null ``doc_id``) count and come back each. Ties for the best partner all count as best. Other columns of the input are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import Hasher, batch_of, chunks, release
from pairspan.session import cut_lineage

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
POOL = 300_000  # stretches whose encoding a task remembers
ENTRIES = 1_500_000  # pairs of documents that a chunk holds, give or take one text's

_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
CHUNK = pa.schema([("chunk", pa.int64()), *[(k, pa.list_(t)) for k, t in _DOC], ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("entries", pa.binary())])
CHUNK_DDL = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, held array<long>, entries binary"
)


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First token of each group in both sequences, from their end offsets (rising, with the same last one)."""
    runs: list[tuple[int, int, int]] = []
    i = j = 0
    na, nb = len(a), len(b)
    while i < na:
        i0, j0, width, rising = i, j, 1, True
        while width:
            width = min(width, na - i, nb - j)
            if width and a[i : i + width] == b[j : j + width]:
                i, j = i + width, j + width
                width = width * 2 if rising else width // 2
            else:
                rising, width = False, width // 2
        if i > i0:
            runs.append((i0, j0, i - i0))
        if i == na:
            break
        runs.append((i, j, 1))
        x, y, i, j = a[i], b[j], i + 1, j + 1
        while x != y:
            if x < y:
                x, i = a[i], i + 1
            else:
                y, j = b[j], j + 1
    run = np.array(runs, np.int64).reshape(-1, 3)
    return _ragged(run[:, 0], run[:, 2]), _ragged(run[:, 1], run[:, 2])


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])


def byte_table_a(path: str) -> tuple[object, list[bytes]]:
    """The byte-level tokenizer and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves in byte-level vocabularies
    rest = [x for x in range(256) if x not in printed]
    byte = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(rest)}
    ids = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(ids.values(), default=-1) + 1)
    for word, k in ids.items():
        table[k] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    return tokenizer, table


def byte_table_b(path: str) -> tuple[object, list[bytes]]:
    """The piece tokenizer and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n, mark = model.get_piece_size(), chr(0x2581)
    table = []
    for k in range(n):
        piece = model.id_to_piece(k)
        if mark in piece.lstrip(mark):
            raise ValueError("a piece goes on with a space after another character, so texts can't be cut at spaces")
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace(mark, " ").encode())
    return model, table


class Units(NamedTuple):
    """What a task knows of the stretches it has met, one row each; ragged columns have their offsets."""

    whole: np.ndarray  # whether both tokenizers give the stretch's bytes back
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text_at: np.ndarray
    text: np.ndarray  # entries of the table of printed ids, group by group
    pair_at: np.ndarray
    pair: np.ndarray  # a * |B| + b
    times: np.ndarray


class Encoder:
    """Both tokenizers, with the stretches that a task has encoded."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.bytes_a = byte_table_a(path_a)
        self.b, self.bytes_b = byte_table_b(path_b)
        self.len_a, self.len_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.n_b = max(1, len(self.bytes_b))
        self.printed = pa.array([f"{k}{c}" for k in range(max(len(self.bytes_a), self.n_b)) for c in ",|;"], pa.large_string())
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        none = np.zeros(0, np.int64)
        self.units = Units(none > 0, none, none, none, none, np.zeros(1, np.int64), none, np.zeros(1, np.int64), none, none)

    def unit_of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of ``units`` for each stretch."""
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(own) > POOL:
            self.reset()
        keys = own.tolist()
        found = [self.known.get(h, -1) for h in keys]
        new = [k for k, u in enumerate(found) if u < 0]
        if new:
            body, at = data.tobytes(), first[new]
            made = self.encode([body[s:e].decode() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            base = len(self.units.n_a)
            for k, place in enumerate(new):
                found[place] = self.known[keys[place]] = base + k
            old = self.units
            joined = {}
            for name in Units._fields:
                x, y = getattr(old, name), getattr(made, name)
                joined[name] = np.concatenate([x, y[1:] + x[-1]]) if name.endswith("_at") else np.concatenate([x, y])
            self.units = Units(**joined)
        return np.array(found, np.int64)[inverse]

    def encode(self, stretches: list[str]) -> Units:
        """Encode and align the stretches, each with one space in front."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        ids_b = self.b.encode(stretches, num_threads=1)
        whole = np.zeros(len(stretches), bool)
        for k, (s, x, y) in enumerate(zip(stretches, ids_a, ids_b, strict=True)):
            body = b" " + s.encode()
            whole[k] = b"".join([self.bytes_a[i] for i in x]) == body == b"".join([self.bytes_b[i] for i in y])
            if not whole[k]:
                ids_a[k], ids_b[k] = [], []
        n_a, n_b = (np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        # end offsets go on from stretch to stretch, and every stretch ends a group
        at_a, at_b = align(np.cumsum(self.len_a[a]).tolist(), np.cumsum(self.len_b[b]).tolist())
        size_a, size_b = np.diff(at_a, append=len(a)), np.diff(at_b, append=len(b))
        n_groups = np.diff(np.searchsorted(at_a, _sums(n_a)))
        n_links = _segment(size_a * size_b, n_groups)
        text, n_text = self._printed_order(a, b, at_a, at_b, size_a, size_b)
        unit = np.repeat(np.arange(len(stretches)), n_groups)
        pair, times, n_pairs = self._pairs(a, b, at_a, at_b, size_a, size_b, unit, len(stretches))
        return Units(whole, n_a, n_b, n_groups, n_links, _sums(_segment(n_text, n_groups)), text, _sums(n_pairs), pair, times)

    @staticmethod
    def _printed_order(a, b, at_a, at_b, size_a, size_b):
        """``a1,a2|b1,b2;`` of every group, as places in the table of printed ids."""
        n = size_a + size_b
        base = np.cumsum(n) - n
        out = np.empty(n.sum(), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[at_a + size_a - 1], mark_b[at_b + size_b - 1] = 1, 2
        out[_ragged(base, size_a)] = 3 * a + mark_a
        out[_ragged(base + size_a, size_b)] = 3 * b + mark_b
        return out, n

    def _pairs(self, a, b, at_a, at_b, size_a, size_b, unit, n_units):
        """Different pairs of each stretch and how often they are linked there. Long groups go by the counts of their ids."""
        links = size_a * size_b
        wide = links > 4096
        small = np.flatnonzero(~wide)
        count = links[small]
        within = _ragged(np.zeros(len(small), np.int64), count)
        group = np.repeat(small, count)
        pair = a[at_a[group] + within // size_b[group]] * self.n_b + b[at_b[group] + within % size_b[group]]
        parts = [(unit[group], pair, np.ones(len(pair), np.int64))]
        for g in np.flatnonzero(wide).tolist():
            x, cx = np.unique(a[at_a[g] : at_a[g] + size_a[g]], return_counts=True)
            y, cy = np.unique(b[at_b[g] : at_b[g] + size_b[g]], return_counts=True)
            parts.append((np.full(len(x) * len(y), unit[g]), (x[:, None] * self.n_b + y).ravel(), (cx[:, None] * cy).ravel()))
        own, pair, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        return _summed(own, pair, times, n_units)


def _segment(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of the given sizes."""
    total = _sums(x)
    at = _sums(sizes)
    return total[at[1:]] - total[at[:-1]]


def _summed(row: np.ndarray, pair: np.ndarray, times: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, pair) in order with the sum of ``times``; last, the number of pairs of each row."""
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(first)
    return pair[at], np.add.reduceat(times, at) if len(at) else times, np.bincount(row[at], minlength=n_rows)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the stretches of all texts; the single space between two stretches belongs to neither."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        before, after = data[:-2], data[2:]
        second = np.concatenate([np.zeros(1, np.uint8), data[:-3]])
        third = np.concatenate([np.zeros(2, np.uint8), data[:-4]])[: n - 2]
        # the character before: printable ASCII, or any other that is no white space of Unicode; a few that are none are left uncut as well
        solid = (before > 0x20) & (before != 0x7F)
        solid &= ~((second == 0xC2) & ((before == 0x85) | (before == 0xA0)))
        solid &= ~((before >= 0x80) & (((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((third == 0xE3) & (second == 0x80))))
        cut[1:-1] = (data[1:-1] == 0x20) & solid & (after > 0x20)
        edge = offsets[1:-1]
        cut[edge[edge < n]] = False  # first byte of a text
        cut[edge[edge > 0] - 1] = False  # its last byte
    places = np.flatnonzero(cut)
    filled = np.diff(offsets) > 0
    start = np.sort(np.concatenate([offsets[:-1][filled], places + 1]))
    end = np.sort(np.concatenate([offsets[1:][filled], places]))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


class _Chunk:
    """Documents of one task until there are enough pairs to write."""

    def __init__(self) -> None:
        self.docs: list[list] = [[] for _ in _DOC]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pairs, times, number of pairs of each document
        self.n = 0

    def add(self, columns: list[list], pair: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> None:
        for held, new in zip(self.docs, columns, strict=True):
            held.extend(new)
        self.parts.append((pair, times, sizes))
        self.n += len(pair)

    def row(self, chunk: int) -> pa.RecordBatch:
        pair, times, sizes = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        columns = {k: [v] for (k, _), v in zip(_DOC, self.docs, strict=True)}
        return batch_of(CHUNK, chunk=[chunk], **columns, pairs=[pairs], held=[held], entries=[pack(sizes, place, times)])


def pack(sizes: np.ndarray, place: np.ndarray, times: np.ndarray) -> bytes:
    """Number of pairs of each document, places of the pairs as steps, and times; bytes of equal rank stand together."""
    step = np.diff(place, prepend=0)
    columns = [x.astype("<i4").view(np.uint8).reshape(-1, 4).T for x in (sizes, step, times)]
    if len(times) and times.max() >= 1 << 31:
        raise OverflowError("a pair is linked over 2^31 times in one text")
    body = np.concatenate([c.ravel() for c in columns]).tobytes()
    return len(sizes).to_bytes(8, "little") + len(place).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    body = np.frombuffer(pa.decompress(packed[16:], 4 * (n + 2 * m), codec="zstd", asbytes=True), np.uint8)

    def column(at: int, size: int) -> np.ndarray:
        return np.ascontiguousarray(body[at : at + 4 * size].reshape(4, size).T).view("<i4").ravel().astype(np.int64)

    return column(0, n), np.cumsum(column(4 * n, m)), column(4 * (n + m), m)


def aligned_rows(encoder: Encoder, hasher: Hasher, ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the documents, then pairs, times and the number of pairs of each document."""
    n = len(ids)
    start, end, row = stretches(data, offsets)
    hasher.load(data)
    unit = encoder.unit_of(hasher.spans(start, end) ^ (end - start).astype(np.uint64), data, start, end) if len(start) else np.zeros(0, np.int64)
    u = encoder.units
    sizes = np.bincount(row, minlength=n)
    good = (_segment((~u.whole[unit]).astype(np.int64), sizes) == 0) & (sizes > 0)
    unit, row = unit[good[row]], row[good[row]]
    sizes = np.where(good, sizes, 0)
    counts = [_segment(x[unit], sizes) for x in (u.n_a, u.n_b, u.n_groups, u.n_links)]

    text = encoder.printed.take(pa.array(u.text[_ragged(u.text_at[unit], np.diff(u.text_at)[unit])]))
    n_text = _segment(np.diff(u.text_at)[unit], sizes)
    places = np.frombuffer(text.buffers()[1], np.int64)[_sums(n_text)] if len(text) else np.zeros(n + 1, np.int64)
    body = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    digests = [hashlib.sha256(body[s : e - 1]).hexdigest() if ok else "" for s, e, ok in zip(places[:-1].tolist(), places[1:].tolist(), good.tolist(), strict=True)]

    n_pairs = np.diff(u.pair_at)[unit]
    at = _ragged(u.pair_at[unit], n_pairs)
    pair, times, held = _summed(np.repeat(row, n_pairs), u.pair[at], u.times[at], n)
    return [ids, *[c.tolist() for c in counts], digests], pair, times, held


def aligned_chunks(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """Chunks of aligned documents (see ``CHUNK``), written to the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, hasher = Encoder(path_a, path_b), Hasher()
        base, k, chunk = TaskContext.get().partitionId() << 32, 0, _Chunk()
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column("text")):
                chunk.add(*aligned_rows(encoder, hasher, b.column("doc_id").slice(lo, hi - lo).to_pylist(), data, offsets))
                if chunk.n >= ENTRIES:
                    yield chunk.row(base + k)
                    k, chunk = k + 1, _Chunk()
                    release()
        if chunk.parts:
            yield chunk.row(base + k)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return cut_lineage(own.mapInArrow(scan, CHUNK_DDL))


@functools.cache
def _width(path_b: str) -> int:
    return max(1, len(byte_table_b(path_b)[1]))


def link_counts(aligned: DataFrame, path_b: str = VOCABULARY_B) -> DataFrame:
    """``pair, a, b, n, best``: how many documents link the ids, and whether no partner of ``a`` has more."""
    n = _width(path_b)
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "held")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.held").alias("n"))
    counts = cut_lineage(rows.select("pair", F.expr(f"pair div {n}").alias("a"), (F.col("pair") % n).alias("b"), "n"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def cross_align(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs`` (doc_id, text)."""
    schema = pa.schema([*_DOC[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), _DOC[5]])
    aligned = aligned_chunks(docs, path_a, path_b)
    met = aligned.select("chunk", F.explode("pairs").alias("pair")).join(link_counts(aligned, path_b), "pair")
    # a chunk has a bounded number of pairs; the sign of a count says whether the partner is the best
    found = met.groupBy("chunk").agg(F.collect_list(F.struct("pair", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n"))).alias("found"))
    # left join: a chunk of empty texts has no pairs
    whole = aligned.select("chunk", *[k for k, _ in _DOC], "entries").join(found, "chunk", "left").drop("chunk")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                found = one.column("found").flatten()
                pair, n = (found.field(f).to_numpy(zero_copy_only=False) for f in ("pair", "n"))
                n = n[np.argsort(pair)]
                sizes, place, times = unpack(one.column("entries")[0].as_py())
                best = _segment(np.where(n > 0, 1, 0)[place] * times, sizes) if len(n) else np.zeros(len(sizes), np.int64)
                total = _segment(np.abs(n)[place] * times, sizes) if len(n) else np.zeros(len(sizes), np.int64)
                yield batch_of(schema, **{f: one.column(f).flatten() for f, _ in _DOC}, n_best=best, count_sum=total)

    return whole.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
