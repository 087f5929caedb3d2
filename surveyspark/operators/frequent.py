"""Most frequent values without shuffling all distinct values.

One pass counts rows per bucket of two independent hashes of the value, so tasks
pass on at most ``2 * BUCKETS`` counts each, whatever the column's cardinality. A
bucket's count bounds the count of every value in it from above. The values that
lie in a heavy bucket of both hashes are counted exactly; the k-th best of them is
a floor for the answer, and every value that reaches it lies in buckets that reach
it. If the heavy buckets include all of those, the answer is proven; otherwise
exactly these buckets are counted once more. The result is always exact, ties
included; only a column whose values are all about equally frequent makes the last
count as wide as a full frequency table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of each hash, and those counted exactly at first.
BUCKETS, HEAVY = 1 << 16, 1 << 10


def _halves(column: str):
    """Buckets of a value by two disjoint parts of its 64-bit hash."""
    h = F.xxhash64(F.col(column))
    return [F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BUCKETS - 1)) for shift in (0, 32)]


def bucket_counts(src: DataFrame, column: str) -> list[np.ndarray]:
    """Rows per bucket, for both hashes; a fixed number of counts in all."""
    spread = F.posexplode(F.array(*_halves(column))).alias("part", "bucket")
    table = src.select(spread).groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = [np.zeros(BUCKETS, np.int64) for _ in range(2)]
    part, bucket, n = (table.column(c).to_numpy() for c in ("part", "bucket", "n"))
    for i in range(2):
        out[i][bucket[part == i]] = n[part == i]
    return out


def count_within(src: DataFrame, column: str, buckets: list[np.ndarray], count_col: str) -> DataFrame:
    """Exact counts of the values whose buckets are all among ``buckets``."""
    keys = ["_bucket_0", "_bucket_1"]
    rows = src.select(F.col(column), *(b.alias(k) for b, k in zip(_halves(column), keys)))
    for key, some in zip(keys, buckets):
        if len(some) < BUCKETS:  # at most BUCKETS rows
            wanted = src.sparkSession.createDataFrame(pa.table({key: pa.array(some, pa.int64())}))
            rows = rows.join(F.broadcast(wanted), key, "left_semi")
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(count_col))


def most_frequent(df: DataFrame, column: str, k: int, dropna: bool = False, count_col: str = "n") -> DataFrame:
    """The ``k`` most frequent values of ``column`` with counts, ties by value
    (missing first). ``dropna=False`` counts missing values as one value; an empty
    table, or ``k`` below 1, gives no rows."""
    src = df.select(column)
    if dropna:
        src = src.where(F.col(column).isNotNull())
    order = [F.col(count_col).desc(), F.col(column).asc_nulls_first()]
    loads = bucket_counts(src, column)
    heavy = [np.argsort(-n, kind="stable")[:HEAVY] for n in loads]
    heavy = [some[n[some] > 0] for n, some in zip(loads, heavy)]
    counted = count_within(src, column, heavy, count_col)
    best = counted.orderBy(*order).limit(max(k, 0)).toArrow()  # k rows
    floor = best.column(count_col)[k - 1].as_py() if 0 < k == best.num_rows else 1
    reach = [np.flatnonzero(n >= floor) for n in loads]
    if k < 1 or all(np.isin(r, h, assume_unique=True).all() for r, h in zip(reach, heavy)):
        return counted.orderBy(*order).limit(max(k, 0))
    return count_within(src, column, reach, count_col).orderBy(*order).limit(k)
