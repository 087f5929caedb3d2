"""Block cross-products against pandas, and bounded samples against a full sort."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import distribution as dist
from surveyspark.operators import split as sp
from surveyspark.operators.moments import correlation_matrix
from surveyspark.operators.sampling import bottom_k
from surveyspark.plans import plan_text


def masked(spark, k, n=250, parts=4):
    rng = np.random.default_rng(k)
    pdf = pd.DataFrame(rng.normal(50, 3, size=(n, k)), columns=[f"c{i}" for i in range(k)])
    pdf["c1"] += pdf["c0"]
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(k))).repartition(parts)


def test_a_hundred_columns_with_missing_values(spark):
    pdf, df = masked(spark, 100)
    got = correlation_matrix(df, list(pdf.columns)).collect()
    want, x = pdf.corr(), pdf.notna().astype(int)
    assert len(got) == 4950
    for r in got:
        assert r["corr"] == pytest.approx(want.loc[r.col_x, r.col_y], abs=1e-10) and r.n == (x[r.col_x] * x[r.col_y]).sum()
    one = got[0]
    assert one.mean_x == pytest.approx(pdf.c0[pdf.c1.notna()].mean()) and one.mean_y == pytest.approx(pdf.c1[pdf.c0.notna()].mean())


def test_matrix_equals_pairwise_sums(spark):
    pdf, df = masked(spark, 5, parts=90)
    a = {(r.col_x, r.col_y): r["corr"] for r in correlation_matrix(df, list(pdf.columns)).collect()}
    b = {(r.col_x, r.col_y): r["corr"] for r in dist.correlation_pairs(df, list(pdf.columns)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-11) for k in a)


def test_matrix_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 1e9, None, 2.0), (2.0, 1e9, None, float("nan")), (3.0, 1e9, 4.0, 5.0)],
                               "a double, `b.c` double, z double, n double")
    got = {(r.col_x, r.col_y): r for r in correlation_matrix(df, ["a", "b.c", "z", "n"]).collect()}
    assert got["a", "b.c"]["corr"] is None and got["a", "b.c"].n == 3
    assert got["a", "z"].n == 1 and got["a", "z"]["corr"] is None and got["a", "z"].mean_x == 3.0
    assert got["a", "n"].n == 2 and got["a", "n"]["corr"] == pytest.approx(1.0)
    none = correlation_matrix(df.limit(0), ["a", "z"]).first()
    assert none.n == 0 and none.mean_x is None and none["corr"] is None


def test_samples_against_a_full_sort(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit(0)).when(F.col("id") % 9 > 0, F.col("id") % 7).alias("g"))
    order = sp.key_hash(["id"], "sample")
    ranked = sorted((r.h, r.id, r.g) for r in df.select("id", "g", order.alias("h")).collect())
    for parts in (1, 7):
        got = bottom_k(df.repartition(parts), order, 50).collect()
        assert sorted(r.id for r in got) == sorted(i for _, i, _ in ranked[:50]) and {r.weight for r in got} == {60.0}
        per = bottom_k(df.repartition(parts), order, 20, ["g"]).collect()
        want = {g: [i for _, i, x in ranked if x == g] for g in {x for *_, x in ranked}}
        assert None in want
        assert {(r.g, r.id) for r in per} == {(g, i) for g, ids in want.items() for i in ids[:20]}
        assert all(r.weight == len(want[r.g]) / min(20, len(want[r.g])) for r in per)
        assert sum(r.weight for r in per) == pytest.approx(3000)


def test_sample_edge_cases_and_plan(spark):
    df = spark.range(5).withColumn("g", F.lit(1))
    assert {r.weight for r in bottom_k(df, F.col("id"), 10).collect()} == {1.0}
    assert bottom_k(df.limit(0), F.col("id"), 10).count() == 0 and bottom_k(df.limit(0), F.col("id"), 10, ["g"]).count() == 0
    with pytest.raises(ValueError):
        bottom_k(df, F.col("id"), 0)
    # each task passes on at most k rows of a group
    plan = plan_text(bottom_k(df.withColumn("g", F.col("id") % 2).repartition(3), F.col("id"), 2, ["g"]), "simple")
    assert plan.count("WindowGroupLimit") >= 2
