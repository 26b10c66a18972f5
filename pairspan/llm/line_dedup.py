"""Line deduplication by an exact set-similarity join: a line goes if an earlier line has a Jaccard similarity of 0.8 or more with it.

A line is the set of its words; earlier means by (doc_id, place in the document). Equal sets are made one first. Words are ordered by rarity, counted over
all lines in a table of fixed size; any order gives the same result, this one keeps groups small. Different sets that reach the similarity share a word of their
prefixes, so each set sends an entry (length, place, 192-bit parity map) for each word of its prefix. In a word's group the length and positional filters
and the parity maps leave few pairs: two sets differ in at least as many words as their maps differ in bits. The words of a hot group are split into tiles by
hash, from the counts known beforehand, and a task takes a pair of tiles. What is left is joined into forests and components, whose members' words are
fetched once and verified exactly, again in pairs of tiles. No pair of lines is ever a row of its own: each set gets its earliest match and its number of links.

Defined results: null counts as empty; lines without words are left as they are; rows without an id come last among equals; repeated rows of a ``doc_id`` are further lines
of it; words are told apart by 48 bits of a hash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import Hasher, batch_of, chunks, mixed, release, words
from pairspan.llm.components import connected, hook
from pairspan.session import cut_lineage

SIMILARITY = 0.8
COUNT_BITS = 18  # of the table of word counts
TILE = 8192  # entries of a word's group, or members of a component, that a task compares with as many others
BUCKET = 50_000  # about how many entries are shuffled and read together
EVERY = 16  # one line in so many sizes the work
SMALL = 24  # members of a component that are compared as Python sets
LAST = np.iinfo(np.int64).max  # place of lines without an id
MAP_WORDS = 3  # 64-bit words of a parity map
#: group: 48 bits of the word (or of the word and a pair of tiles), then 16 of its place in the set; a place over 65,535 counts as that, which filters less
ENTRY = np.dtype([("group", "<u8"), ("line", "<u8"), ("n", "<u4"), ("map", "<u8", (MAP_WORDS,))])
SLOTS = np.arange(1 << COUNT_BITS, dtype=np.uint64)


def _line_words(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of each word, and row and first line of each row; lines are numbered through the chunk."""
    w = words(data, offsets)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    n_lines = np.bincount(row_of_break, minlength=len(offsets) - 1) + 1
    first = np.cumsum(n_lines) - n_lines
    hasher.load(data)
    # breaks before a word, plus one line for each earlier row
    return hasher.spans(w.start, w.end), np.searchsorted(breaks, w.start) + w.row, np.repeat(np.arange(len(n_lines)), n_lines), first


def _sets(token: np.ndarray, line: np.ndarray, rank: np.ndarray = SLOTS, slot: np.ndarray = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words (48 bits) and lines, sorted by line, ``rank`` of the word's count slot, and word; ``slot`` undoes ``rank``.

    One number holds line, rank and 30 more bits of the word, so that a plain sort does it, 2^16 lines at a time.
    """
    words_, lines_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    key = (rank[(token >> np.uint64(46)).astype(np.int64)] << np.uint64(30)) | ((token >> np.uint64(16)) & np.uint64((1 << 30) - 1))
    base = int(line[0]) if len(line) else 0
    while len(key):
        end = int(np.searchsorted(line, base + (1 << 16)))
        own = np.sort(key[:end] | ((line[:end] - base).astype(np.uint64) << np.uint64(48)))
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        lines_.append((own >> np.uint64(48)).astype(np.int64) + base)
        words_.append((slot[((own >> np.uint64(30)) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)] << np.uint64(30)) | (own & np.uint64((1 << 30) - 1)))
        key, line = key[end:], line[end:]
        base = int(line[0]) if len(line) else 0
    return np.concatenate(words_), np.concatenate(lines_)


def _slots(word: np.ndarray) -> np.ndarray:
    """Count slots of 48-bit words."""
    return (word >> np.uint64(30)).astype(np.int64)


class _Seen:
    """Hashes met lately, a slot each; forgetting one only sends it again."""

    def __init__(self) -> None:
        self.table = np.zeros(1 << 19, np.uint64)

    def fresh(self, h: np.ndarray) -> np.ndarray:
        """Places of one of each hash that wasn't met."""
        at = np.flatnonzero(self.table[(h >> np.uint64(45)).astype(np.int64)] != h)
        at = at[np.unique(h[at], return_index=True)[1]]
        self.table[(h[at] >> np.uint64(45)).astype(np.int64)] = h[at]
        return at


def _set_hash(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of each set, whatever its order."""
    return mixed(np.add.reduceat(mixed(token ^ np.uint64(0x5BD1E995)), start)) if len(start) else np.zeros(0, np.uint64)


def _starts(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(line)]]))


def _count(docs: DataFrame, similarity: float) -> DataFrame:
    """Lines ``doc_id, line, words, set`` and, in rows without a set, ``slot, n, m``: how many lines have a word of the slot, and about how many have one in their prefix.

    There are 2^18 slots, whatever the input. The first count orders words. The second only sizes the work, and takes the prefixes of one line in ``EVERY`` by the
    order that the task knows so far.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("words", pa.int32()), ("set", pa.int64()), ("slot", pa.int32()), ("n", pa.int64()), ("m", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, heads = Hasher(), np.zeros(1 << COUNT_BITS, np.int64), np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            ids = b.column("doc_id")
            for lo, _, data, offsets in chunks(b.column("text")):
                token, line, row_of, first = _line_words(data, offsets, hasher)
                some = line % EVERY == 0
                early = np.minimum(total, (1 << COUNT_BITS) - 1).astype(np.uint64)
                part, part_line = token[some], line[some]
                token, line = _sets(token, line)
                start, n = _starts(line)
                of = _set_hash(token, start)
                row = row_of[line[start]]
                none = [None] * len(of)
                yield batch_of(schema, doc_id=ids.take(pa.array(lo + row)), line=line[start] - first[row], words=n, set=of.view(np.int64), slot=none, n=none, m=none)
                total += np.bincount(_slots(token), minlength=1 << COUNT_BITS)
                # ranks that tie mix up slots of like counts, which is near enough here
                order = np.lexsort((early[(part >> np.uint64(46)).astype(np.int64)], part_line))
                part, part_line = part[order], part_line[order]
                start, n = _starts(part_line)
                p = prefix_size(n, similarity)
                at = np.repeat(start, p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                heads += EVERY * np.bincount((part[at] >> np.uint64(46)).astype(np.int64), minlength=1 << COUNT_BITS)
            release()
        own = np.flatnonzero(total)
        none = [None] * len(own)
        yield batch_of(schema, doc_id=none, line=none, words=none, set=none, slot=own, n=total[own], m=heads[own])

    return docs.mapInArrow(count, "doc_id long, line int, words int, `set` long, slot int, n long, m long")


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """Words of the prefix of a set of n: two sets that reach the similarity share one of theirs."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def _entries(docs: DataFrame, counts: np.ndarray, heads: np.ndarray, similarity: float, tile: int) -> DataFrame:
    """Packed entries of prefixes by bucket: ``bucket, packed``."""
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.uint64)
    slot = np.argsort(rank).astype(np.uint64)
    tiles = np.clip(-(-heads // tile), 1, 65535)
    buckets = np.uint64(min(1 << 30, max(64, int(heads.sum()) // BUCKET)))
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        all_ = np.concatenate(held)
        bucket = ((all_["group"] >> np.uint64(16)) % buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        return batch_of(schema, bucket=own, packed=[x.tobytes() for x in np.split(all_[order], first[1:])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, seen = Hasher(), [], 0, _Seen()
        for b in batches:
            for _, _, data, offsets in chunks(b.column("text")):
                token, line, _, _ = _line_words(data, offsets, hasher)
                token, line = _sets(token, line, rank, slot)
                start, n = _starts(line)
                of = _set_hash(token, start)
                # sets of up to 1/(1-similarity) - 1 words match equal sets only; those met in this task are sent once
                long = np.flatnonzero(n * (1 - similarity) >= similarity - 1e-9)
                fresh = long[seen.fresh(of[long])]
                if not len(fresh):
                    continue
                n, start, of = n[fresh], start[fresh], of[fresh]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                token = token[np.repeat(start, n) + inner]
                start = np.cumsum(n) - n
                place = mixed(token ^ np.uint64(0xA0761D64)) >> np.uint64(32)
                bit, which = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(6)) % np.uint64(MAP_WORDS)
                p = prefix_size(n, similarity)
                at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                e = np.zeros(len(at), ENTRY)
                word = token[np.repeat(start, p) + at]
                for k in range(MAP_WORDS):
                    e["map"][:, k] = np.repeat(np.bitwise_xor.reduceat(np.where(which == k, bit, np.uint64(0)), start), p)
                e["line"], e["n"] = np.repeat(of, p), np.repeat(n, p)
                e["group"] = (word << np.uint64(16)) | np.minimum(at, 65535).astype(np.uint64)
                k = tiles[_slots(word)]
                hot = k > 1
                if hot.any():  # an entry of tile t goes to the pairs (t, u) of all k tiles u
                    few, kk = e[hot], k[hot]
                    few, many = np.repeat(few, kk), np.repeat(kk, kk)
                    mine = ((few["line"] >> np.uint64(7)) % many.astype(np.uint64)).astype(np.int64)
                    other = np.arange(len(few)) - np.repeat(np.cumsum(kk) - kk, kk)
                    pair = (np.minimum(other, mine) * many + np.maximum(other, mine)).astype(np.uint64)
                    group = mixed((few["group"] >> np.uint64(16)) ^ (pair << np.uint64(24))) & np.uint64((1 << 48) - 1)
                    few["group"] = (group << np.uint64(16)) | (few["group"] & np.uint64(65535))
                    e = np.concatenate([e[~hot], few])
                held.append(e)
                size += e.nbytes
                if size > 16 << 20:
                    yield emit(held)
                    held, size = [], 0
            release()
        if held:
            yield emit(held)

    return docs.mapInArrow(scan, "bucket int, packed binary")


def group_links(e: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs that the filters leave in the groups of the entries: node and root, as set hashes."""
    e = e[np.lexsort((e["n"], e["group"] >> np.uint64(16)))]
    own, place = np.unique(e["line"], return_inverse=True)
    group, n, at = e["group"] >> np.uint64(16), e["n"].astype(np.int64), (e["group"] & np.uint64(65535)).astype(np.int64)
    maps = np.ascontiguousarray(e["map"])
    most = np.floor(n / similarity + 1e-9).astype(np.int64)
    parent = np.arange(len(own))
    active, d = np.arange(len(e)), 0
    while True:
        d += 1
        active = active[active + d < len(e)]
        j = active + d
        ok = (group[j] == group[active]) & (n[j] <= most[active])
        active, j = active[ok], j[ok]
        if not len(active):
            moved = np.flatnonzero(parent != np.arange(len(own)))
            return own[moved], own[parent[moved]]
        total = n[active] + n[j]
        need = np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)
        # words before this one are rarer; at most the smaller place of them is shared, and what comes after
        could = np.minimum(at[active], at[j]) + 1 + np.minimum(n[active] - at[active] - 1, n[j] - at[j] - 1)
        ok = np.flatnonzero(could >= need)
        ok = ok[np.bitwise_count(maps[active[ok]] ^ maps[j[ok]]).sum(1) <= (total - 2 * need)[ok]]
        if len(ok):
            parent = hook(parent, place[active[ok]], place[j[ok]])


def _edges(entries: DataFrame, similarity: float) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, table):
        e = np.concatenate([np.zeros(0, ENTRY), *(np.frombuffer(x.as_py(), ENTRY) for x in table.column("packed"))])
        node, root = group_links(e, similarity)
        return pa.Table.from_batches([batch_of(schema, a=node.view(np.int64), b=root.view(np.int64))])

    return entries.groupBy("bucket").applyInArrow(run, "a long, b long")


BITMAP = 24  # bits of the number of slots that tell which sets are in a component


def _bits(slots: DataFrame) -> np.ndarray:
    """Packed bits of a column ``slot`` of numbers below 2^24."""
    table = np.zeros(1 << BITMAP, bool)
    for r in slots.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.collect_set(F.col("slot").bitwiseAND(F.lit(31)).cast("int")).alias("bits")).toLocalIterator():
        table[np.array(r["bits"]) + (r["w"] << 5)] = True
    return np.packbits(table)


def _doc_slot(doc_id: Column) -> Column:
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(doc_id), 64 - BITMAP), F.lit(0))


def _members(docs: DataFrame, sets: np.ndarray, ids: np.ndarray) -> DataFrame:
    """``set, packed`` words of the sets whose slot is on, from documents whose slot is on, at most once a task."""
    schema = pa.schema([("set", pa.int64()), ("packed", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own_ids, hasher, seen = np.unpackbits(sets).astype(bool), np.unpackbits(ids).astype(bool), Hasher(), _Seen()
        for b in batches:
            b = b.filter(pa.array(own_ids[b.column("slot").to_numpy()]))
            for _, _, data, offsets in chunks(b.column("text")):
                token, line, _, _ = _line_words(data, offsets, hasher)
                token, line = _sets(token, line)
                start, n = _starts(line)
                of = _set_hash(token, start)
                own = np.flatnonzero(table[(of >> np.uint64(64 - BITMAP)).astype(np.int64)])
                own = own[seen.fresh(of[own])]
                blobs = [token[s : s + k].tobytes() for s, k in zip(start[own].tolist(), n[own].tolist(), strict=True)]
                yield batch_of(schema, set=of[own].view(np.int64), packed=blobs)
            release()

    return docs.select("text", _doc_slot(docs["doc_id"]).alias("slot")).mapInArrow(scan, "`set` long, packed binary")


def similar_pairs(x: list[np.ndarray], y: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Matrix of which sets of x and y (x and x if None) reach the similarity, by counting shared words column block by column block."""
    other = x if y is None else y
    words_, inverse = np.unique(np.concatenate([*x, *(other if y is not None else [])]), return_inverse=True)
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in other])
    split = nx.sum()
    rx, cx = np.repeat(np.arange(len(x)), nx), inverse[:split]
    ry, cy = (rx, cx) if y is None else (np.repeat(np.arange(len(other)), ny), inverse[split:])
    # a word of one side only is never shared; with y None, a word of one set only
    useful = (np.bincount(cx, minlength=len(words_)) > (y is None)) & (np.bincount(cy, minlength=len(words_)) > 0)
    column = np.cumsum(useful) - 1
    shared = np.zeros((len(x), len(other)), np.float32)
    for lo in range(0, int(useful.sum()), 2048):
        def block(r, c, m):
            c_, keep = column[c], useful[c]
            keep &= (c_ >= lo) & (c_ < lo + 2048)
            out = np.zeros((m, 2048), np.float32)
            out[r[keep], c_[keep] - lo] = 1
            return out
        a = block(rx, cx, len(x))
        shared += a @ (a if y is None else block(ry, cy, len(other))).T
    if y is None:
        shared[np.arange(len(x)), np.arange(len(x))] = nx
    total = nx[:, None] + ny[None, :]
    return shared >= np.ceil(similarity / (1 + similarity) * total - 1e-9)


def _compare(sets: list[np.ndarray], doc: np.ndarray, line: np.ndarray, mine: np.ndarray, theirs: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of sets ``mine`` (places): number of similar sets among ``theirs``, and document and line of the earliest."""
    size = np.array([len(s) for s in sets])
    links, best = np.zeros(len(mine), np.int64), np.full((len(mine), 2), LAST)
    if len(mine) <= SMALL and len(theirs) <= SMALL:
        a, b = [set(sets[i].tolist()) for i in mine], [set(sets[i].tolist()) for i in theirs]
        for x, i in enumerate(mine):
            for y, j in enumerate(theirs):
                if i != j and len(a[x] & b[y]) >= math.ceil(similarity / (1 + similarity) * int(size[i] + size[j]) - 1e-9):
                    links[x] += 1
                    best[x] = min(tuple(best[x]), (doc[j], line[j]))
        return links, best[:, 0], best[:, 1]
    order = np.argsort(size[mine], kind="stable")  # by size, so that a block of rows meets a narrow range of columns
    theirs = theirs[np.argsort(size[theirs], kind="stable")]
    for at in range(0, len(mine), 1024):
        rows = order[at : at + 1024]
        own = mine[rows]
        near = theirs[(size[theirs] >= np.ceil(similarity * size[own[0]] - 1e-9)) & (size[theirs] <= np.floor(size[own[-1]] / similarity + 1e-9))]
        for c in range(0, len(near), 1024):
            part = near[c : c + 1024]
            part = part[np.lexsort((line[part], doc[part]))]
            like = similar_pairs([sets[i] for i in own], [sets[i] for i in part], similarity) & (own[:, None] != part[None, :])
            links[rows] += like.sum(1)
            got = np.flatnonzero(like.any(1))
            first = part[like[got].argmax(1)]
            r = rows[got]
            better = (doc[first] < best[r, 0]) | ((doc[first] == best[r, 0]) & (line[first] < best[r, 1]))
            best[r[better]] = np.stack([doc[first], line[first]], 1)[better]
    return links, best[:, 0], best[:, 1]


def _verify(members: DataFrame, similarity: float, tile: int) -> DataFrame:
    """``set, before, links``: the earliest similar set's place and the number of similar sets.

    A component of more than ``tile`` members is compared by pairs of its tiles; many small ones share a group.
    """
    members = cut_lineage(members)
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = max(16, members.count() // 2048)
    k = F.ceil(F.col("size") / F.lit(float(tile))).cast("int")
    placed = members.join(sizes, "label").withColumn("k", k).withColumn("t", F.pmod(F.xxhash64("set"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("u")
    alone = F.col("k") == 1
    work = placed.select("label", "set", "doc_id", "line", "packed", "t", "k", other).select(
        "label", "set", "doc_id", "line", "packed", "t", F.when(alone, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.col("label")).alias("g"),
        F.when(alone, -1).otherwise(F.least("t", "u")).alias("lo"), F.when(alone, -1).otherwise(F.greatest("t", "u")).alias("hi"),
    )
    schema = pa.schema([("set", pa.int64()), ("bid", pa.int64()), ("bline", pa.int32()), ("links", pa.int64())])

    def run(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        label, t, ids, line = (table.column(c).to_numpy() for c in ("label", "t", "set", "line"))
        doc = pa.compute.fill_null(table.column("doc_id"), LAST).to_numpy()
        sets = [np.frombuffer(p, np.uint64) for p in table.column("packed").to_pylist()]
        out = []
        if lo < 0:
            order = np.argsort(label, kind="stable")
            work = [(own, own) for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)]
        elif lo == hi:
            whole = np.arange(len(t))
            work = [(whole, whole)]
        else:
            one, two = np.flatnonzero(t == lo), np.flatnonzero(t == hi)
            work = [(one, two), (two, one)]
        for mine, theirs in work:
            links, bid, bline = _compare([sets[i] for i in np.concatenate([mine, theirs])], *(v[np.concatenate([mine, theirs])] for v in (doc, line)), np.arange(len(mine)), np.arange(len(theirs)) + (len(mine) if mine is not theirs else 0), similarity)
            some = np.flatnonzero(links)
            out.append((ids[mine[some]], bid[some], bline[some], links[some]))
        own, bid, bline, links = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_batches([batch_of(schema, set=own, bid=pa.array(bid, mask=bid == LAST), bline=bline.clip(0, 2**31 - 1), links=links)])

    found = work.groupBy("g", "lo", "hi").applyInArrow(run, "`set` long, bid long, bline int, links long")
    last = F.struct(F.col("bid").isNull().alias("no"), "bid", "bline")
    return found.groupBy("set").agg(F.min(last).alias("before"), F.sum("links").alias("links"))


def line_matches(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``doc_id, line, words, copies, links, gone`` for every line of ``docs`` (doc_id, text) that has words.

    ``copies`` counts the lines of the same set, ``links`` the other sets that are similar; ``gone`` tells whether an earlier line is equal or similar.
    """
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    counted = cut_lineage(_count(docs, similarity))
    lines = counted.where("`set` is not null").select("doc_id", "line", "words", "set")
    got = counted.where("`set` is null").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    counts, heads = (np.zeros(1 << COUNT_BITS, np.int64) for _ in range(2))
    counts[got.column("slot").to_numpy()], heads[got.column("slot").to_numpy()] = got.column("n").to_numpy(), got.column("m").to_numpy()
    labels = connected(_edges(_entries(docs, counts, heads, similarity, tile), similarity))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "line")
    firsts = cut_lineage(lines.groupBy("set").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")))
    sets = _bits(labels.select(F.shiftrightunsigned("node", 64 - BITMAP).alias("slot")))
    ids = _bits(labels.join(firsts, labels.node == firsts.set).select(_doc_slot(F.col("first.doc_id")).alias("slot")))
    fetched = _members(docs, sets, ids).groupBy("set").agg(F.first("packed").alias("packed"))
    members = labels.join(fetched, labels.node == fetched.set).join(firsts, "set")
    members = members.select("label", "set", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), "packed")
    verified = _verify(members, similarity, tile)
    known = firsts.join(verified, "set", "left").select(F.col("set").alias("of"), "first", "copies", "before", F.coalesce("links", F.lit(0)).alias("links"))
    met = lines.join(known, lines.set == known.of)
    ahead = F.struct(F.col("before.no").alias("no"), F.col("before.bid").alias("doc_id"), F.col("before.bline").alias("line"))
    mine = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "line")
    gone = (F.col("first") < mine) | F.coalesce(F.col("before").isNotNull() & (ahead < mine), F.lit(False))
    return met.select("doc_id", "line", "words", "copies", "links", gone.alias("gone"))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Rows of ``docs`` without the lines that repeat earlier ones; a document that had words and loses all of them goes.

    ``n_chars``, if there is such a column, follows the text. Rows without an id keep their text, as their lines can't be named.
    """
    found = line_matches(docs, similarity, tile)
    cut = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("lines"), F.max((~F.col("gone")).cast("int")).alias("left")
    ).where(F.size("lines") > 0)
    met = docs.join(cut, docs["doc_id"] == cut["of"], "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(cut["lines"], i)), "\n")
    text = F.when(cut["of"].isNull(), docs["text"]).otherwise(kept)
    new = {"text": text} | ({"n_chars": F.when(cut["of"].isNull(), docs["n_chars"]).otherwise(F.char_length(kept).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return met.where(cut["of"].isNull() | (cut["left"] > 0)).select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
