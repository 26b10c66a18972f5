"""Texts of an Arrow batch as flat byte arrays: words and their 64-bit hashes by numpy, no loop per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash is a polynomial over its bytes modulo 2^64, mixed
at the end; two different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts handled together; a longer single text makes a chunk of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after its last
    row: np.ndarray  # row of the chunk that it belongs to


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of consecutive rows; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of all rows; a row's end ends its word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    at = offsets[:-1][filled]
    first[at] = solid[at]
    at = offsets[1:][filled] - 1
    last[at] = solid[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of the numbers over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hasher:
    """Hashes of any spans of a number sequence (bytes or code points) from one pass over it."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) >= n:
            return
        for name, base in (("_up", _BASE), ("_down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        self._powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._down[start])


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def release() -> None:
    """Give memory of past batches back, for the worker stays while the executor works on other things."""
    pa.default_memory_pool().release_unused()
