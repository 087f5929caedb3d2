"""Distribution operators against brute-force pandas/numpy computations."""

import numpy as np
import pandas as pd
import pytest

from surveyspark.operators import distribution as dist


def _mpl_box(vals, whis=1.5):
    """Box statistics computed the way matplotlib's boxplot_stats does."""
    x = np.asarray(vals, dtype=float)
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    lo, hi = q1 - whis * iqr, q3 + whis * iqr
    wlo = x[x >= lo]
    whi = x[x <= hi]
    whislo = q1 if len(wlo) == 0 or wlo.min() > q1 else wlo.min()
    whishi = q3 if len(whi) == 0 or whi.max() < q3 else whi.max()
    fliers = int(((x < whislo) | (x > whishi)).sum())
    return q1, med, q3, whislo, whishi, fliers


def test_box_stats_match_matplotlib_rules(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 3, 400)
    v = np.round(rng.lognormal(3, 0.8, 400), 1)
    v[:5] = [900.0, 0.1, 850.0, 0.2, 777.0]          # plant outliers
    rows = [(int(a), float(b)) for a, b in zip(g, v)]
    rows[10] = (rows[10][0], None)
    rows[11] = (None, rows[11][1])
    df = spark.createDataFrame(rows, "g int, v double")
    out = {r.g: r for r in dist.box_stats(df, "v", "g").collect()}
    clean = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    assert set(out) == set(clean.g.astype(int).unique())
    for key, grp in clean.groupby("g"):
        q1, med, q3, wlo, whi, fl = _mpl_box(grp.v.values)
        r = out[int(key)]
        assert r.n == len(grp)
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
        assert (r.whislo, r.whishi) == pytest.approx((wlo, whi))
        assert r.n_outliers == fl
        assert r.mean == pytest.approx(grp.v.mean())


def test_box_stats_single_value_group(spark):
    df = spark.createDataFrame([(1, 5.0)], "g int, v double")
    r = dist.box_stats(df, "v", "g").first()
    assert (r.q1, r.median, r.q3, r.whislo, r.whishi, r.n_outliers) == (5, 5, 5, 5, 5, 0)


def test_histogram_includes_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,)], "x double")
    out = [(r.bin, r.n) for r in dist.histogram(df, "x", 5).orderBy("bin").collect()]
    assert out == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 1)]


def test_bin_counts_match_pandas_cut(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 97, 500), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {r.bin: r.n for r in dist.bin_counts(df, "x", 5).collect()}
    cats = pd.cut(x, 5, right=False, labels=False)
    want = pd.Series(cats).value_counts().to_dict()
    assert got == {k + 1: v for k, v in want.items()}


def test_bin_exclude_codes_do_not_shape_range(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (10.0,)], "x double")
    out = dist.with_bins(df, "x", 2, exclude=[-3.0]).orderBy("x").collect()
    assert [r.bin for r in out] == [None, 1, 2]
    assert out[1].bin_lo == 0.0 and out[1].bin_hi == 5.0


def test_top_values_ties_by_value_and_semi_join(spark):
    vals = [5] * 3 + [1] * 2 + [2] * 2 + [9]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    top = [(r.x, r.n) for r in dist.top_values(df, "x", 3).collect()]
    assert top == [(5, 3), (1, 2), (2, 2)]
    kept = sorted(r.x for r in dist.rows_with_top_values(df, "x", 3).collect())
    assert kept == sorted(v for v in vals if v != 9)


def test_correlation_pairs(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(size=200), "c": rng.normal(size=200)})
    out = {(r.col_x, r.col_y): r.corr
           for r in dist.correlation_pairs(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), v in out.items():
        assert v == pytest.approx(pdf[x].corr(pdf[y]))


def test_joint_histogram_counts_all_rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "y": rng.normal(size=300)})
    out = dist.joint_histogram(spark.createDataFrame(pdf), "x", "y", 4, 3).collect()
    assert sum(r.n for r in out) == 300
    assert all(1 <= r.bin_x <= 4 and 1 <= r.bin_y <= 3 for r in out)


def test_semi_join_keeps_missing_when_frequent(spark):
    vals = [None, None, None, 1, 1, 2]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    kept = [r.x for r in dist.rows_with_top_values(df, "x", 2).collect()]
    assert sorted(kept, key=lambda v: (v is not None, v)) == [None, None, None, 1, 1]


def test_box_stats_takes_any_column_names(spark):
    from surveyspark.operators.distribution import box_stats

    rows = [(g, float(v)) for g in (0, 1) for v in range(10 + g)]
    want = box_stats(spark.createDataFrame(rows, "g int, v double"), "v", "g").orderBy("g").collect()
    for value, group in (("n", "mean"), ("mean", "n"), ("min", "q1"), ("_v", "_g0"), ("_x", "a.b")):
        df = spark.createDataFrame(rows, ["k", "x"]).toDF(group, value)
        got = box_stats(df, value, group)
        assert got.columns[0] == group
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want)


def test_correlations_with_missing_values(spark):
    import numpy as np
    import pandas as pd

    from surveyspark.operators.distribution import correlation_pairs
    from surveyspark.plans import plan_text

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["d"] = 3.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    got = correlation_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"))
    plan, want = plan_text(got, "simple"), pdf.corr()
    for r in got.collect():
        if "d" in (r.col_x, r.col_y):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - want.loc[r.col_x, r.col_y]) < 1e-12
    assert plan.count("HashAggregate(") == 2  # one aggregate, partial and final, whatever the values


def test_column_histograms_match_single_histograms(spark):
    from surveyspark.operators.distribution import column_histograms, histogram

    df = spark.range(200).selectExpr("id % 17 a", "id * 0.5 `b.c`", "cast(null as double) z")
    got = column_histograms(df, ["a", "b.c", "z"], 7).collect()
    for name, col in (("a", "a"), ("b.c", "bc")):
        one = histogram(df.toDF("a", "bc", "z"), col, 7).where("n > 0").collect()
        assert sorted((r.bin, r.bin_lo, r.bin_hi, r.n) for r in got if r.column_name == name) == sorted(tuple(r) for r in one)
    assert not [r for r in got if r.column_name == "z"]
