"""Column profiling: types and non-null counts, summary statistics,
frequency tables, sentinel shares.

Each profile is a single aggregation pass. Wide results are turned long
with ``inline(array(struct ...))`` so one row describes one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, non-null and null counts.

    One scan; every ``count(c)`` is a partial aggregate combined map-side.
    """
    structs = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"),
                 F.lit(dtype).alias("data_type"),
                 F.count(F.col(name)).alias("non_null"))
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*structs).alias("cols"))
    return (wide.select("rows", F.inline("cols"))
                .select("position", "column_name", "data_type", "rows", "non_null",
                        (F.col("rows") - F.col("non_null")).alias("null_count")))


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unpivot ``columns`` to ``(position, column_name, value double)``."""
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.col(c).cast("double").alias("value"))
               for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*structs)))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """count, mean, sample std, min, quartiles, max for every numeric column.

    Moments are one map-side aggregate over the wide rows; exact quartiles
    (linear interpolation between order statistics) come from
    ``quantiles.exact_quantiles``, whose passes shuffle bucket counts per column,
    never values. The input is read again by each pass, so write an expensive one
    first. ``exact=False`` uses the one-pass ``percentile_approx`` sketch instead.
    """
    cols = list(columns) if columns else numeric_columns(df)
    v = F.col("value")
    long = long_values(df, cols)
    keys = ["position", "column_name"]
    if not exact:
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        out = long.groupBy(*keys).agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v, probs, accuracy).alias("q"))
        return out.select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                          F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    stats = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.count(e).alias("count"),
                               F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.min(e).alias("min"),
                               F.max(e).alias("max")) for i, (c, e) in enumerate(zip(cols, x))])
    moments = df.agg(stats.alias("s")).select(F.inline("s"))
    quarts = exact_quantiles(long, "value", ["position"], [0.25, 0.5, 0.75], names=["p25", "p50", "p75"])
    return (moments.join(quarts, "position", "left")
                   .select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def value_counts(df: DataFrame, column: str, dropna: bool = True,
                 count_col: str = "n") -> DataFrame:
    """Frequency table of ``column``, most frequent first (ties by value).

    ``dropna=False`` keeps missing values as their own group. The result has
    one row per distinct value, so the final sort is over the aggregate,
    not the rows.
    """
    src = df.select(column)
    if dropna:
        src = src.where(F.col(column).isNotNull())
    return (src.groupBy(column).agg(F.count(F.lit(1)).alias(count_col))
               .orderBy(F.col(count_col).desc(), F.col(column).asc_nulls_first()))


def sentinel_share(df: DataFrame, sentinels: Mapping[str, Sequence]) -> DataFrame:
    """Per column: rows holding a sentinel code, non-null rows, and the
    percentage ``100 * sentinel / non_null``. One pass for all columns."""
    structs = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.count_if(F.col(c).isin(list(codes))).alias("sentinel_rows"),
                 F.count(F.col(c)).alias("non_null"))
        for i, (c, codes) in enumerate(sentinels.items())
    ]
    return (df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
              .withColumn("pct", F.lit(100.0) * F.col("sentinel_rows") / F.col("non_null")))
