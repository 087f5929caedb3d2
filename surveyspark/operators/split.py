"""Reproducible splits and fold assignment.

``randomSplit`` and ``rand(seed)`` depend on how rows are partitioned, so
the same seed picks different rows after a repartition. Here every row's
side is a function of its own key through a hash: stable across runs,
partitionings and cluster sizes, and computed inside the scan stage with
no shuffle.

``with_exact_split`` gives an exact-size split (first ``ceil(f * n)`` rows
in hash order) without sorting or ranking anything: counts per bucket narrow
the boundary, column by column, until it is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..plans import written

HASH_DIGITS = 15
HASH_RANGE = 16**HASH_DIGITS


def key_hash(key: Sequence[str], salt: str = "") -> Column:
    """Integer in [0, 2**60): the first 15 hexadecimal digits of the MD5 of the
    salt and the key columns as text. Portable to any SQL engine; different
    salts give independent numbers."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def with_split(df: DataFrame, hash_col: Column, train_pct: int = 70,
               out: str = "split") -> DataFrame:
    """``out`` = 'train' when ``hash % 100 < train_pct``, else 'test'."""
    return df.withColumn(out, F.when(F.pmod(hash_col, F.lit(100)) < train_pct, F.lit("train"))
                               .otherwise(F.lit("test")))


def hash_split(df: DataFrame, hash_col: Column, train_pct: int = 70
               ) -> tuple[DataFrame, DataFrame]:
    h = F.pmod(hash_col, F.lit(100))
    return df.where(h < train_pct), df.where(h >= train_pct)


def with_folds(df: DataFrame, hash_col: Column, k: int, out: str = "fold") -> DataFrame:
    """Integer fold ``0..k-1`` per row, from the row's hash."""
    return df.withColumn(out, F.pmod(hash_col, F.lit(k)).cast("int"))


def with_random_folds(df: DataFrame, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Fold from a seeded uniform column: fold i holds ``[i/k, (i+1)/k)``.
    Partition-dependent, like ``randomSplit``; prefer ``with_folds``."""
    return df.withColumn(out, F.least(F.floor(F.rand(seed) * k), F.lit(k - 1)).cast("int"))


def with_exact_split(df: DataFrame, test_fraction: float, order_col: str,
                     tiebreak: Sequence[str], buckets: int = 1 << 16,
                     out: str = "split") -> DataFrame:
    """Mark the first ``ceil(test_fraction * n)`` rows in ``(order_col,
    *tiebreak)`` order as 'test', the rest 'train'.

    The columns must be integers; nulls sort first. ``df`` is read once a pass, so
    it must give the same rows each time (files, or deterministic expressions).

    No sort, no ranking and no copy: for each order column in turn, rows that
    agree with the cutoff so far are counted per bucket of the column's range (at
    most ``buckets`` counts; a running sum over them finds the bucket with the
    boundary), and that bucket is counted again until it is one value or the
    boundary coincides with its end. A pass reads the order columns that are in
    use and returns one row to the driver; 60 bits take at most four passes of
    65,536 buckets. Ties that the last column leaves are cut by a hash of the whole
    row, and only rows that are equal as a whole and hold the cutoff are written,
    with row numbers, so that exactly the rows still needed are taken.
    """
    need, before, tied = None, F.lit(False), F.lit(True)   # rows before the cutoff; rows that agree with it
    columns = [F.col(f"`{c}`").cast("bigint") for c in (order_col, *tiebreak)]
    for x in [*columns, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]:
        rows = df.where(tied).select(x.alias("_x"))
        found = _extent(rows)
        if need is None:
            n = found["n"]
            need = math.ceil(float(test_fraction) * n)     # double arithmetic, as splitters do
            if need <= 0 or need >= n:
                return df.withColumn(out, F.lit("test" if need > 0 else "train"))
        less, at, need = _cutoff(rows, found, x, need, buckets)
        before, tied = before | (tied & less), tied & at
        if not need:
            return df.withColumn(out, _side(before))
    number = "_split_row_no"
    equal = written(df.where(tied).withColumn(number, F.monotonically_increasing_id()))
    rows = equal.select(F.col(number).alias("_x"))
    less, _, _ = _cutoff(rows, _extent(rows), F.col(number), need, buckets)
    return (df.where(~tied).withColumn(out, _side(before))
              .unionByName(equal.withColumn(out, _side(less)).drop(number)))


def _extent(rows: DataFrame) -> Row:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_x").isNull()).alias("missing"),
                    F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()


def _cutoff(rows: DataFrame, found: Row, x: Column, need: int, buckets: int) -> tuple[Column, Column, int]:
    """The first ``need`` (fewer than all) of ``rows`` in the order of ``_x``, nulls
    first, as (before, at, rest): all rows ``before`` and ``rest`` of the rows ``at``
    one value; ``rest`` is 0 where the cutoff lies between two values. The
    conditions are over ``x``, which ``_x`` was made of."""
    if need <= found["missing"]:
        return (x.isNull(), F.lit(False), 0) if need == found["missing"] else (F.lit(False), x.isNull(), need)
    need, lo, hi = need - found["missing"], found["lo"], found["hi"]
    while lo < hi:
        step = -(-(hi - lo + 1) // buckets)
        bucket = F.expr(f"cast((cast(_x as decimal(20,0)) - {lo}) div {step} as bigint)")
        counts = (rows.where(F.col("_x").between(lo, hi))
                      .groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")))
        running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = (counts.withColumn("_cum", F.sum("_c").over(running))   # at most `buckets` rows
                     .where(F.col("_cum") >= F.lit(need)).orderBy("_b").first())
        need -= hit["_cum"] - hit["_c"]
        lo, hi = lo + hit["_b"] * step, min(hi, lo + (hit["_b"] + 1) * step - 1)
        if need == hit["_c"]:                              # the cutoff is the bucket's end
            return x.isNull() | (x <= F.lit(hi)), F.lit(False), 0
    return x.isNull() | (x < F.lit(lo)), x.eqNullSafe(F.lit(lo)), need


def _side(before: Column) -> Column:
    return F.when(before, F.lit("test")).otherwise(F.lit("train"))
