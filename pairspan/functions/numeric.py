"""Guarded numeric column expressions.

Spark's ANSI mode raises on division by zero, so every ratio goes through ``try_divide`` and
statistics of constant series come out NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments; NULL where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, F.lit(1)))
    sx, sy = F.sum(F.when(both, x)), F.sum(F.when(both, y))
    sxx, syy = F.sum(F.when(both, x * x)), F.sum(F.when(both, y * y))
    sxy = F.sum(F.when(both, x * y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    eps = F.lit(1e-9)
    return F.when((vx > eps * sxx) & (vy > eps * syy), ratio(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def log_positive(col: Column) -> Column:
    """Natural logarithm, NULL for values that have none."""
    return F.when(col > 0, F.ln(col))
