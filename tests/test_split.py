"""Splits: hash stability, fold coverage, exact-size split vs a full sort."""

import math

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import split as sp
from surveyspark.plans import plan_text


@pytest.fixture()
def keyed(spark):
    return spark.range(0, 2000).select(F.col("id").alias("k"),
                                       (F.col("id") * 37 % 101).alias("v"))


def test_hash_split_is_partitioning_independent(keyed):
    h = sp.key_hash(["k"])
    a = {r.k for r in sp.hash_split(keyed, h, 70)[1].collect()}
    b = {r.k for r in sp.hash_split(keyed.repartition(7), h, 70)[1].collect()}
    assert a == b
    assert 0.2 < len(a) / 2000 < 0.4


def test_folds_cover_rows_once(keyed):
    out = sp.with_folds(keyed, sp.key_hash(["k"]), 3)
    counts = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == 2000


def expected_test_rows(rows, fraction):
    return sorted(rows)[:math.ceil(fraction * len(rows))]


@pytest.mark.parametrize("fraction,buckets", [
    (0.3, 4), (0.3, 2), (0.3, 64), (0.0, 8), (1.0, 8), (0.123, 1 << 16), (0.7, 3)])
def test_exact_split_matches_full_sort(keyed, fraction, buckets):
    # 997 order values for 2000 rows: ties on the order value, broken by key
    order = keyed.withColumn("o", F.pmod(F.col("k") * 7919 + 13, F.lit(997)))
    out = sp.with_exact_split(order, fraction, "o", ["k"], buckets=buckets)
    got = sorted((r.o, r.k) for r in out.where(F.col("split") == "test").collect())
    assert got == expected_test_rows([(r.o, r.k) for r in order.collect()], fraction)
    assert out.count() == 2000 and out.columns == order.columns + ["split"]


@pytest.mark.parametrize("n,keys,fraction", [(100, 2, 0.3), (500, 1, 0.5), (97, 7, 0.9), (64, 1, 0.01)])
def test_exact_split_is_exact_on_duplicate_keys(spark, n, keys, fraction):
    df = spark.range(n).selectExpr(f"id % {keys} k", f"id % {keys} * 5 o", "id % 3 payload").repartition(4)
    out = sp.with_exact_split(df, fraction, "o", ["k"], buckets=8)
    test = out.where("split = 'test'").collect()
    assert len(test) == math.ceil(fraction * n) and out.count() == n
    want = expected_test_rows([(r.o, r.k) for r in df.collect()], fraction)
    assert sorted((r.o, r.k) for r in test) == want


def test_exact_split_with_equal_hashes_extremes_and_nulls(spark):
    rows = [(0, -2**63), (0, 2**63 - 1), (0, 5), (0, None), (None, 1), (None, None), (0, 5), (0, -7)]
    df = spark.createDataFrame(rows, "o long, k long")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    for m in range(1, len(rows)):
        out = sp.with_exact_split(df, m / len(rows), "o", ["k"], buckets=3)
        got = sorted(((r.o, r.k) for r in out.where("split = 'test'").collect()), key=key)
        assert got == sorted(rows, key=key)[:m]


def test_exact_split_writes_nothing_but_equal_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sp, "written", lambda df: kept.append(df.collect()) or df)
    df = spark.range(3000).selectExpr("id k", "id * 7919 % 100 o", "repeat('x', 100) payload")
    sp.with_exact_split(df, 0.3, "o", ["k"], buckets=16).count()
    sp.with_exact_split(df, 0.305, "o", [], buckets=16).count()      # the row hash decides
    assert not kept
    twice = df.union(df.where("o = 50"))                             # 3,030 rows, 30 of them twice
    out = sp.with_exact_split(twice, 1500.5 / 3030, "o", ["k"], buckets=16)
    assert [len(rows) for rows in kept] == [2] and out.count() == 3030
    assert out.where("split = 'test'").count() == 1501


def test_exact_split_passes_read_the_order_columns_only(spark, scratch, monkeypatch):
    spark.range(2000).selectExpr("id k", "id % 10 o", "repeat('x', 100) payload").write.parquet(f"{scratch}/t")
    plans, extent = [], sp._extent
    monkeypatch.setattr(sp, "_extent", lambda rows: plans.append(plan_text(rows)) or extent(rows))
    out = sp.with_exact_split(spark.read.parquet(f"{scratch}/t"), 0.305, "o", ["k"], buckets=64)
    assert len(plans) == 2 and not any("payload" in p for p in plans)
    assert out.where("split = 'test'").count() == 610


def test_split_sides_and_folds_are_independent_of_the_label_noise(spark):
    """Within each activity the label's noise term does not differ by side."""
    from surveyspark import catalog as C

    noise = ((F.col("l_orderkey") * 7919 + F.col("l_partkey")) % 100) / 25.0
    df = sp.with_folds(sp.with_split(C.cleaned(spark, "/root/testdata/sf0.1"), C.portable_hash("split")),
                       C.portable_hash("fold"), 4).withColumn("noise", noise)
    for side in ("split", "fold"):
        means = df.groupBy("activity_n", side).agg(F.avg("noise").alias("m"), F.stddev("noise").alias("s"),
                                                   F.count("*").alias("n")).collect()
        for r in means:
            others = [o for o in means if o.activity_n == r.activity_n]
            overall = sum(o.m * o.n for o in others) / sum(o.n for o in others)
            assert abs(r.m - overall) < 5 * r.s / math.sqrt(r.n)
    sides = df.groupBy("split", "fold").count().collect()
    total = sum(r["count"] for r in sides)
    for r in sides:
        assert abs(r["count"] / total - (0.7 if r["split"] == "train" else 0.3) / 4) < 0.005
