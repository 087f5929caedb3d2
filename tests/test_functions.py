"""Column helpers: null-aware code predicates, calendar fields, bin edges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyspark.functions import (bin_index, bin_label, case_month, case_year, drop_codes,
                                   in_interval, keep_codes, not_equal)


def _vals(df, col="x"):
    return sorted((r[col] for r in df.collect()), key=lambda v: (v is None, v))


def test_keep_codes_drops_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (-1,), (None,)], "x int")
    assert _vals(df.where(keep_codes("x", [1, 2]))) == [1, 2]


def test_drop_codes_keeps_nulls_by_default(spark):
    df = spark.createDataFrame([(1,), (-1,), (-2,), (None,)], "x int")
    assert _vals(df.where(drop_codes("x", [-1, -2]))) == [1, None]
    assert _vals(df.where(drop_codes("x", [-1, -2], keep_null=False))) == [1]


def test_not_equal_null_rule(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")
    assert _vals(df.where(not_equal("x", -1))) == [1.0, None]
    assert _vals(df.where(not_equal("x", -1, keep_null=False))) == [1.0]


def test_interval_and_complement_partition_rows(spark):
    df = spark.range(0, 100).select((F.col("id") / 100).alias("r"))
    cond = in_interval("r", 0.3, 0.6)
    assert df.where(cond).count() + df.where(~cond).count() == 100
    assert df.where(cond).count() == 30


def test_case_calendar_from_bigint(spark):
    df = spark.createDataFrame([(20140102000123,), (20151231999999,)], "id bigint")
    out = df.select(case_year("id").alias("y"), case_month("id").alias("m")).collect()
    assert [(r.y, r.m) for r in out] == [("2014", "01"), ("2015", "12")]


def test_case_calendar_survives_double_ids(spark):
    # a double id would print as 2.0140102000123E13 without the bigint cast
    df = spark.createDataFrame([(20140102000123.0,)], "id double")
    r = df.select(case_year("id").alias("y"), case_month("id").alias("m")).first()
    assert (r.y, r.m) == ("2014", "01")


def _bins(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    whole = Window.partitionBy()
    lo, hi = F.min("x").over(whole), F.max("x").over(whole)
    return [r.b for r in df.select("x", bin_index(F.col("x"), lo, hi, n).alias("b"))
            .orderBy(F.col("x").asc_nulls_last()).collect()]


def test_bins_left_closed_and_max_in_last_bin(spark):
    # range 0..10 in 5 bins of width 2: 2.0 opens bin 2, 10 (max) stays in bin 5
    assert _bins(spark, [0.0, 1.99, 2.0, 9.99, 10.0], 5) == [1, 1, 2, 5, 5]


def test_constant_column_goes_to_middle_bin(spark):
    assert _bins(spark, [3.0, 3.0], 5) == [3, 3]
    assert _bins(spark, [3.0, 3.0], 10) == [6, 6]


def test_null_gets_no_bin(spark):
    assert _bins(spark, [0.0, 1.0, None], 2)[-1] is None


def test_bin_label_lookup(spark):
    df = spark.createDataFrame([(1,), (3,)], "b int")
    out = [r.l for r in df.select(bin_label(F.col("b"), ["a", "b", "c"]).alias("l")).collect()]
    assert out == ["a", "c"]
