"""Null-aware predicates over coded columns.

Survey codes mark "no answer" with negative sentinels, while real missing
values are null. A frame-style filter ``x != s`` or ``~x.isin(S)`` keeps
missing rows, but the same text in SQL evaluates to null and drops them.
These helpers make the choice explicit.

The keep-null forms are written ``x IS NULL OR NOT x IN (...)`` rather than
``coalesce(NOT x IN (...), true)``: both mean the same, but only the first
reaches the parquet reader as a pushed filter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_codes(c: str | Column, codes: Iterable) -> Column:
    """Allow-list: rows whose value is one of ``codes``; nulls are dropped."""
    return _col(c).isin(list(codes))


def drop_codes(c: str | Column, codes: Iterable, keep_null: bool = True) -> Column:
    """Deny-list: rows whose value is not one of ``codes``.

    ``keep_null=True`` keeps missing values (frame semantics); ``False``
    gives plain SQL semantics where null rows fall away.
    """
    col = _col(c)
    cond = ~col.isin(list(codes))
    return (col.isNull() | cond) if keep_null else cond


def not_equal(c: str | Column, value, keep_null: bool = True) -> Column:
    """``c != value``, keeping nulls unless ``keep_null`` is False."""
    col = _col(c)
    cond = col != F.lit(value)
    return (col.isNull() | cond) if keep_null else cond


def in_interval(c: str | Column, lo: float, hi: float) -> Column:
    """Half-open interval ``lo <= c < hi``; its complement is ``~in_interval``."""
    col = _col(c)
    return (col >= F.lit(lo)) & (col < F.lit(hi))
