"""Running a small numpy function over many pairs per Arrow batch.

Spark joins and spreads the pairs; a batch of pairs of equal length is stacked into a matrix, so
the function works on many pairs at once. Quadratic work inside a pair goes block by block, so
memory stays bounded whatever the series length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pairspan.operators.shared import active

CELLS = 250_000  # numbers held at once by a quadratic step: a block fits the processor cache


def lists_to_numpy(col: pa.Array) -> list[np.ndarray]:
    """One float vector per list; NULL elements become NaN."""
    col = col.cast(pa.list_(pa.float64()))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(size)[:-1]) if len(col) else []


def map_arrays(df: DataFrame, keys: list[str], arrays: list[str], fn: Callable, out: list[str], power: int = 2) -> DataFrame:
    """Append ``fn(*matrices) -> dict of vectors`` to the keys; NULL where an array holds a NULL.

    ``power`` says how the memory of ``fn`` grows with the length, to choose the rows per call. Over a table that several statistics share, their
    functions run in one pass.
    """
    own = active()
    key = own.key_of(df) if own else None
    if key is not None:
        return own.mapped(key, df, (keys, arrays, fn, out, power))
    return map_kernels(df, keys, [(arrays, fn, out, out, power)])


def map_kernels(df: DataFrame, keys: list[str], kernels: list[tuple[list[str], Callable, list[str], list[str], int]]) -> DataFrame:
    """Append the columns of several functions (arrays, function, its names, names of the columns, power) to the keys."""
    names = [n for *_, columns, _ in kernels for n in columns]
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` double" for n in names])
    read = sorted({a for arrays, *_ in kernels for a in arrays})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows == 0:
                continue
            lists = {a: lists_to_numpy(rb.column(rb.schema.get_field_index(a))) for a in read}
            columns = [rb.column(rb.schema.get_field_index(k)) for k in keys]
            for arrays, fn, out, _, power in kernels:
                res = apply_kernel([lists[a] for a in arrays], fn, out, power)
                columns += [pa.array(res[:, j], from_pandas=True) for j in range(len(out))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    return df.select(*keys, *read).mapInArrow(run, schema)


def apply_kernel(cols: list[list[np.ndarray]], fn: Callable, out: list[str], power: int) -> np.ndarray:
    """One row for each row of the columns; rows of equal length go through ``fn`` together."""
    size = np.array([len(c) for c in cols[0]])
    res = np.full((len(size), len(out)), np.nan)
    for n in np.unique(size):
        if n < 2:
            continue
        idx = np.flatnonzero(size == n)
        step = max(1, int(CELLS // n**power))
        for at in range(0, len(idx), step):
            part = idx[at : at + step]
            mats = [np.stack([c[i] for i in part]) for c in cols]
            good = ~np.any([np.isnan(m).any(axis=1) for m in mats], axis=0)
            if good.any():
                with np.errstate(all="ignore"):
                    got = fn(*[m[good] for m in mats])
                for j, name in enumerate(out):
                    res[part[good], j] = got[name]
    res[~np.isfinite(res)] = np.nan
    return res


def row_blocks(batch: int, n: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, batch * n))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def map_whole(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of tables that hold whole groups of rows of equal keys, several at a time and in key order.

    Like a grouped map, with one call for the groups of an Arrow batch: small groups share the numpy calls. A group that spans batches is held until its last row.
    """

    def changes(rb: pa.RecordBatch | pa.Table) -> np.ndarray:
        same = np.ones(max(rb.num_rows - 1, 0), bool)
        for k in keys:
            c = rb.column(rb.schema.get_field_index(k))
            same &= pc.equal(c.slice(1), c.slice(0, rb.num_rows - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(~same) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            if rb.num_rows == 0:
                continue
            ends = changes(rb)
            if held and len(changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), rb.slice(0, 1)]).combine_chunks())):
                ends = np.append([0], ends)
            if not len(ends):
                held.append(rb)
                continue
            whole = [*held, rb.slice(0, int(ends[-1]))]
            held = [rb.slice(int(ends[-1]))]
            yield from fn(pa.Table.from_batches(whole).combine_chunks()).to_batches()
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group of a table in key order."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table[k].combine_chunks()
        new[1:] |= ~pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def local_codes(group: np.ndarray, groups: int, *columns: pa.ChunkedArray) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Names of all groups in order; for each group, in rows, which of them it has; and the columns as numbers within their group's names."""
    names = sorted(set().union(*(pc.unique(c).to_pylist() for c in columns)))
    codes = [pc.index_in(c, pa.array(names, pa.string())).to_numpy() for c in columns]
    there = np.zeros((groups, len(names)), bool)
    for c in codes:
        there[group, c] = True
    place = np.cumsum(there, axis=1) - 1
    return names, there, [place[group, c] for c in codes]
