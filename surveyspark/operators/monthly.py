"""Monthly means from a packed case id.

Year and month are text fields cut from the case id (see
``functions.calendar``). The three tables of the analysis -- mean by month
within each year, and by month over all years -- come from one scan with
``GROUPING SETS ((year, month), (month))``: one partial aggregate, one
shuffle of at most ``years x months`` partial rows per map task, instead
of three separate group-bys.

Means include sentinel codes unless ``exclude`` names them, matching the
analysed notebook, which averages the raw column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import case_month, case_year


def with_calendar(df: DataFrame, id_col: str, year_col: str = "year",
                  month_col: str = "month") -> DataFrame:
    return df.withColumn(year_col, case_year(id_col)).withColumn(month_col, case_month(id_col))


def _value_aggs(values: Sequence[str], exclude: Mapping[str, Sequence] | None):
    aggs = []
    for v in values:
        col = F.col(v)
        if exclude and v in exclude:
            col = F.when(~F.col(v).isin(list(exclude[v])), F.col(v))
        aggs.append(F.avg(col).alias(f"mean_{v}"))
    return aggs


def monthly_mean(df: DataFrame, values: Sequence[str], year: str | None = None,
                 exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Mean of ``values`` by (year, month); ``year`` restricts to one year.

    Expects ``year``/``month`` text columns (``with_calendar``). Rows with a
    missing month are not a group.
    """
    src = df.where(F.col("month").isNotNull())
    if year is not None:
        src = src.where(F.col("year") == F.lit(year))
    return (src.groupBy("year", "month")
               .agg(F.count(F.lit(1)).alias("rows"), *_value_aggs(values, exclude)))


def monthly_mean_all_years(df: DataFrame, values: Sequence[str],
                           exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    return (df.where(F.col("month").isNotNull()).groupBy("month")
              .agg(F.count(F.lit(1)).alias("rows"), *_value_aggs(values, exclude)))


def monthly_mean_grouping_sets(df: DataFrame, values: Sequence[str],
                               exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Both monthly tables in one pass.

    ``level`` is ``grouping_id(year, month)``: 0 for (year, month) rows,
    2 for the all-years row of a month (``year`` null there).
    """
    src = df.where(F.col("month").isNotNull())
    return (src.groupingSets([["year", "month"], ["month"]], "year", "month")
               .agg(F.grouping_id("year", "month").alias("level"),
                    F.count(F.lit(1)).alias("rows"), *_value_aggs(values, exclude)))
