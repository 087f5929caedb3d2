"""Head / tail previews.

Row order in a file is not a property a distributed scan keeps, so a
preview is defined by an explicit key. ``orderBy(key).limit(n)`` plans as a
per-partition top-n followed by a merge of n-row lists
(``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in key]).limit(n)


def tail(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(k).desc_nulls_last() for k in key]).limit(n)
