"""Calendar fields packed into a numeric case id.

Case ids carry the interview date in their leading digits: characters 1-4
are the year and 5-6 the month, both kept as zero-padded text. The id must
be an integral type; a double would print in scientific notation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").cast("string")


def case_year(c: str | Column) -> Column:
    return F.substring(_text(c), 1, 4)


def case_month(c: str | Column) -> Column:
    return F.substring(_text(c), 5, 2)
