"""Most frequent values against full counts: skew, ties, nulls, kinds of values."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import frequent as fr


def plain(values, k, dropna=False):
    counts = Counter(v for v in values if not (dropna and v is None))
    order = sorted(counts.items(), key=lambda c: (-c[1], c[0] is not None, c[0] if c[0] is not None else 0))
    return order[:k]


def run(df, k, **kw):
    return [(r.x, r.n) for r in fr.most_frequent(df, "x", k, **kw).collect()]


@pytest.mark.parametrize("buckets,heavy", [(1 << 16, 1 << 10), (64, 4), (8, 2), (2, 1)])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_against_full_counts(spark, monkeypatch, buckets, heavy, k):
    monkeypatch.setattr(fr, "BUCKETS", buckets)
    monkeypatch.setattr(fr, "HEAVY", heavy)
    rng = np.random.default_rng(buckets + k)
    values = [int(v) if v % 11 else None for v in rng.zipf(1.4, 3000) % 400]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    for dropna in (False, True):
        assert run(df, k, dropna=dropna) == plain(values, k, dropna)


def test_ties_at_the_cutoff_go_by_value(spark, monkeypatch):
    monkeypatch.setattr(fr, "HEAVY", 3)
    values = [v for v in range(50) for _ in range(4)] + [60] * 9
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert run(df, 7) == plain(values, 7)


def test_strings_zeros_empty_and_large_k(spark):
    words = ["b", "a", None, "b", "", "a", "c"]
    assert run(spark.createDataFrame([(w,) for w in words], "x string"), 99) == [
        ("a", 2), ("b", 2), (None, 1), ("", 1), ("c", 1)]
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (float("nan"),), (float("nan"),), (float("nan"),)], "x double")
    (top, n), (zero, m) = run(zeros, 2)
    assert top != top and n == 3 and zero == 0 and m == 2
    empty = spark.createDataFrame([], "x string")
    assert run(empty, 3) == [] and run(zeros, 0) == []
    nulls = spark.createDataFrame([(None,)] * 3, "x int")
    assert run(nulls, 2) == [(None, 3)] and run(nulls, 2, dropna=True) == []


def test_few_distinct_values_are_shuffled(spark):
    """A column of 200,000 distinct values and a few frequent ones: the exact count
    sees the candidates only, and is proven without a second one."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.col("id") + 1000).alias("x"))
    calls = []
    real = fr.count_within

    def counting(src, column, buckets, count_col):
        out = real(src, column, buckets, count_col)
        calls.append(out.count())
        return out

    fr.count_within = counting
    try:
        got = run(df, 5)
    finally:
        fr.count_within = real
    assert sorted(n for _, n in got) == sorted(plain([i % 7 for i in range(0, 300_000, 3)], 5)[i][1] for i in range(5))
    assert len(calls) == 1 and calls[0] < 2000
