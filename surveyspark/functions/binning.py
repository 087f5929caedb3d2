"""Equal-width bin expressions.

Bins follow the left-closed convention of an equal-width cut over the
observed range: bin ``i`` (1-based) is ``[lo + (i-1)w, lo + iw)`` with
``w = (hi - lo) / n``, except that the last bin also holds ``hi`` itself.
A constant column (``hi == lo``) lands in the middle bin, as a cut over a
slightly widened range would place it. Nulls get no bin.

The range usually comes from a one-row ``min``/``max`` aggregate joined onto
the rows, so the expression takes Columns, not Python numbers: no action
runs until the caller's own action.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based bin number of ``x`` for ``n`` equal-width bins over [lo, hi]."""
    raw = F.floor((x - lo) * F.lit(n) / (hi - lo)) + F.lit(1)
    return (F.when(x.isNull(), F.lit(None))
             .when(hi == lo, F.lit(n // 2 + 1))
             .otherwise(F.least(raw, F.lit(n)))
             .cast("int"))


def bin_lower(b: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + (hi - lo) * (b - F.lit(1)) / F.lit(n)


def bin_upper(b: Column, lo: Column, hi: Column, n: int) -> Column:
    return lo + (hi - lo) * b / F.lit(n)


def bin_label(b: Column, labels: Sequence[str] | None) -> Column:
    """Label of bin ``b``: ``labels[b-1]``; without labels, the bin number."""
    if not labels:
        return b.cast("string")
    return F.element_at(F.array(*[F.lit(s) for s in labels]), b)


# Fixed label list used by the analysed notebook, in its order. Labels are
# assigned lowest bin first, so with this list the LOWEST bin is named
# "Very High"; pass ``LABELS_LOW_FIRST`` for the natural reading.
REFERENCE_LABELS = ["Very High", "High", "Med", "Low", "Very Low"]
LABELS_LOW_FIRST = ["Very Low", "Low", "Med", "High", "Very High"]
