"""SimHash near-duplicates: every pair of fingerprints is compared, in tiles, by numpy exclusive-or and bit counts.

Fingerprints are made distinct first, sorted by the bit counts of their four quarters and cut into tiles. A pair of tiles is skipped when the bit counts of
the whole or of the quarters differ beyond the radius, since each differing count needs that many differing bits; inside a pair the same rule skips
blocks. A task turns the links that it finds into a forest (fewer edges than nodes), so a group of k near copies never becomes k^2 rows. Components come
from the forests; no link between different texts is lost.

Defined results: null counts as empty; texts without words have fingerprint zero and link like any other; repeated rows of a ``doc_id`` get the same answer;
a null ``doc_id`` never names a component unless all its members are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import batch_of
from pairspan.llm.components import connected, hook
from pairspan.session import cut_lineage

WIDTH, RADIUS = 4, 4
SEED = 42
BLOCK = 512  # fingerprints of a block inside a tile
TILE_LEAST, TILE_MOST, TILES = 4096, 1 << 17, 256  # tile sizes, and about how many tiles before they reach the largest size


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each set if over half of the hashes of the shingles have it."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 15):
        spans = zip(starts[lo : min(n, lo + (1 << 15))].tolist(), last[lo : lo + (1 << 15)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` (bigint with the 64 bits) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield batch_of(schema, doc_id=b.column("doc_id"), fp=fps)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit quarters, and of the whole."""
    parts = [np.bitwise_count((fp >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF)) for i in range(4)]
    return np.stack([*parts, np.bitwise_count(fp)], axis=1).astype(np.int16)


def _apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, radius: int) -> np.ndarray:
    """Whether ranges of bit counts rule out any pair within the radius; last axis: the four quarters and the whole."""
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return (gap[..., :4].sum(-1) > radius) | (gap[..., 4] > radius)


def _signature(fp):
    """Sort key: bit counts of whole and quarters, so that fingerprints of a tile are alike in them."""
    quarter = [F.bit_count(F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quarter)], fp.alias("fp"))


def tiles(distinct: DataFrame, tile: int) -> DataFrame:
    """``tile, fps`` (packed, sorted by signature) and the ranges of bit counts ``low, high``; one row per at most ``tile`` fingerprints."""
    n = max(1, -(-distinct.count() // tile))
    schema = "tile long, fps binary, low array<short>, high array<short>"
    out = pa.schema([("tile", pa.int64()), ("fps", pa.binary()), ("low", pa.list_(pa.int16())), ("high", pa.list_(pa.int16()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        rest = np.zeros(0, np.int64)
        for b in [*batches, None]:
            if b is not None:
                rest = np.concatenate([rest, b.column("fp").to_numpy(zero_copy_only=False)])
            while len(rest) >= tile or (b is None and len(rest)):
                own, rest = rest[:tile], rest[tile:]
                q = _quarters(own.view(np.uint64))
                yield batch_of(out, tile=[base + k], fps=[own.tobytes()], low=[q.min(0).tolist()], high=[q.max(0).tolist()])
                k += 1

    ranged = distinct.select(_signature(F.col("fp")).alias("s")).repartitionByRange(n, "s").sortWithinPartitions("s").select("s.fp")
    return ranged.mapInArrow(pack, schema)


def links_of(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within the radius among x and y (only inside x if y is None): node and root, as places in x then y."""
    both = x if y is None else np.concatenate([x, y])
    parent = np.arange(len(both))
    shift = 0 if y is None else len(x)
    other = x if y is None else y

    def ranges(v):
        q = _quarters(v)
        at = np.arange(0, len(v), BLOCK)
        return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)

    (lx, hx), (ly, hy) = ranges(x), ranges(other)
    differ, counts = np.empty((BLOCK, BLOCK), np.uint64), np.empty((BLOCK, BLOCK), np.uint8)
    for i in range(len(lx)):
        a = x[i * BLOCK : (i + 1) * BLOCK]
        near = np.flatnonzero(~_apart(lx[i], hx[i], ly, hy, radius))
        for j in near[near >= i] if y is None else near:
            b = other[j * BLOCK : (j + 1) * BLOCK]
            np.bitwise_xor(a[:, None], b[None, :], out=differ[: len(a), : len(b)])
            bits = np.bitwise_count(differ[: len(a), : len(b)], out=counts[: len(a), : len(b)])
            if bits.min() <= radius:
                p, q = np.nonzero(bits <= radius)
                parent = hook(parent, p + i * BLOCK, q + j * BLOCK + shift)
    moved = np.flatnonzero(parent != np.arange(len(both)))
    return both[moved], both[parent[moved]]


def tile_pairs(tiled: DataFrame, radius: int) -> DataFrame:
    """``a, b`` (a <= b): pairs of tiles that bit counts don't rule out. Only numbers of tiles and ranges move here.

    Tiles meet by each bit count of the whole that one holds and the other can reach, so this is an equi-join of two small tables.
    """
    meta = tiled.select("tile", "low", "high")
    left = meta.select(F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.col("low")[4].cast("int"), F.col("high")[4].cast("int"))).alias("bits"))
    right = meta.select(
        F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"),
        F.explode(F.sequence(F.col("low")[4].cast("int") - radius, F.col("high")[4].cast("int") + radius)).alias("bits"),
    )
    gap = sum((F.greatest(F.lit(0), F.col("la")[i] - F.col("hb")[i], F.col("lb")[i] - F.col("ha")[i]) for i in range(4)), F.lit(0))
    return left.join(right, "bits").where("a <= b").where(gap <= radius).select("a", "b").distinct()


def near_edges(distinct: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """``a, b`` (bigint fingerprints): edges that connect exactly what links within the radius connect."""
    if tile is None:
        tile = min(TILE_MOST, max(TILE_LEAST, -(-distinct.count() // TILES)))
    tiled = cut_lineage(tiles(distinct, tile))
    pairs = tile_pairs(tiled, radius)
    one = tiled.select(F.col("tile").alias("a"), F.col("fps").alias("fa"))
    two = tiled.select(F.col("tile").alias("b"), F.col("fps").alias("fb"))
    work = pairs.join(one, "a").join(two, "b")
    # tile pairs are heavy and few: spread them evenly, whatever joined them
    work = work.repartition(max(work.sparkSession.sparkContext.defaultParallelism * 4, 12), "a", "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = np.frombuffer(batch.column("fa")[r].as_py(), np.uint64)
                y = None if batch.column("a")[r].equals(batch.column("b")[r]) else np.frombuffer(batch.column("fb")[r].as_py(), np.uint64)
                node, root = links_of(x, y, radius)
                yield batch_of(schema, a=node.view(np.int64), b=root.view(np.int64))

    return work.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (doc_id, text); the component's smallest ``doc_id`` names it."""
    marked = cut_lineage(fingerprints(docs, width))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(near_edges(distinct.select("fp"), radius, tile))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(tops, "label").select(F.col("fp").alias("of"), "component_id")
    return marked.join(classes, marked.fp == classes.of).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` whose document stands for its component; one row of a repeated ``doc_id``.

    Rows without an id can't be told apart by one: those of a component that has other ids go, those of a component without any stay.
    """
    found = near_duplicates(docs, width, radius)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    some = docs.join(stays.where("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    none = docs.where("doc_id is null")
    if stays.where("doc_id is null").isEmpty():
        return some.select(*docs.columns)
    return some.select(*docs.columns).unionAll(none)
