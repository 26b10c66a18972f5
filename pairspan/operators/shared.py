"""Tables that several statistics of one panel read, computed once.

Inside ``sharing(panel)`` the functions marked with ``shared`` give every caller the same table for the same arguments, and the numpy kernels that ``map_arrays`` runs over one pair table
go over it together. Statistics with kernels are called twice: first to learn which kernels run over which table, then, after one pass over each table, to be built from the results.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.session import cut_lineage

_active: ContextVar[Sharing | None] = ContextVar("sharing", default=None)


class Sharing:
    def __init__(self, panel: DataFrame) -> None:
        self.panel = panel
        self.tables: dict[tuple, DataFrame] = {}
        self.kernels: dict[tuple, list[tuple]] = {}  # of each pair table: (keys, arrays, function, names, power)
        self.results: dict[tuple, DataFrame] = {}
        self.asked: dict[tuple, int] = {}

    def table(self, key: tuple, make: Callable[[], DataFrame], written: bool) -> DataFrame:
        if key not in self.tables:
            made = make()
            self.tables[key] = cut_lineage(made) if written else made
        return self.tables[key]

    def key_of(self, df: DataFrame) -> tuple | None:
        return next((k for k, t in self.tables.items() if t is df), None)

    def mapped(self, key: tuple, df: DataFrame, kernel: tuple) -> DataFrame:
        """The columns of a kernel: empty while kernels are learned, then from the pass over the table. Kernels are told apart by the order of the calls."""
        keys, _, _, out, _ = kernel
        if key not in self.results:
            self.kernels.setdefault(key, []).append(kernel)
            return df.select(*keys, *[F.lit(None).cast("double").alias(n) for n in out])
        place = self.asked.get(key, 0)
        self.asked[key] = place + 1
        if self.kernels[key][place][3] != out:
            raise RuntimeError("statistics asked for other kernels the second time")
        return self.results[key].select(*keys, *[F.col(f"`{place}|{n}`").alias(n) for n in out])

    def learned(self) -> int:
        """The number of kernels asked for up to now."""
        return sum(len(k) for k in self.kernels.values())

    def run(self) -> None:
        """One pass over each pair table for all its kernels, written to the shared folder."""
        from pairspan.functions.batches import map_kernels

        for key, kernels in self.kernels.items():
            named = [(arrays, fn, out, [f"{k}|{n}" for n in out], power) for k, (_, arrays, fn, out, power) in enumerate(kernels)]
            self.results[key] = cut_lineage(map_kernels(self.tables[key], kernels[0][0], named))


@contextmanager
def sharing(panel: DataFrame) -> Iterator[Sharing]:
    own = Sharing(panel)
    token = _active.set(own)
    try:
        yield own
    finally:
        _active.reset(token)


def active() -> Sharing | None:
    return _active.get()


def shared(written: bool):
    """Mark a function of a panel: callers that share the panel get one table for the same arguments, written once if ``written``."""

    def mark(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        takes = inspect.signature(fn)

        @functools.wraps(fn)
        def wrapper(panel: DataFrame, *args, **kw) -> DataFrame:
            own = active()
            if own is None or panel is not own.panel:
                return fn(panel, *args, **kw)
            bound = takes.bind(panel, *args, **kw)
            bound.apply_defaults()
            key = (fn.__name__, *[v for k, v in bound.arguments.items() if k != "panel" and not isinstance(v, dict)], *sorted(bound.arguments.get("kw", {}).items()))
            return own.table(key, lambda: fn(panel, *args, **kw), written)

        return wrapper

    return mark
