"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_file_name(df: DataFrame, col: str) -> DataFrame:
    """``subject.scan.session.*`` to three columns."""
    parts = F.split(col, r"\.")
    return df.withColumns({"subject": parts[0], "scan": parts[1], "session": parts[2]})


def split_pair(df: DataFrame, col: str) -> DataFrame:
    """``a__b`` to two columns."""
    parts = F.split(col, "__")
    return df.withColumns({"class_a": parts[0], "class_b": parts[1]})


def significance_label(flag: Column) -> Column:
    return F.when(flag, "Significant SPIs").otherwise("Not Sig")


def module_label(number: Column) -> Column:
    return F.format_string("M%02d", number)


def band_weight(x: Column, thresholds: tuple, weights: tuple = (2.0, 0.75, 0.1)) -> Column:
    """Weight of the first threshold that ``x`` reaches, else 0; NULL and NaN count as 0.

    Thresholds may be numbers or columns.
    """
    out = F.when(x.isNull() | F.isnan(x), 0.0)
    for t, w in zip(thresholds, weights):
        out = out.when(x >= t, w)
    return out.otherwise(0.0)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)
