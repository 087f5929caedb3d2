"""Exact distributed quantiles against numpy, with forced refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators.quantiles import exact_quantiles

PROBS = [0.25, 0.5, 0.75]


@pytest.mark.parametrize("buckets", [1024, 4, 16])
def test_matches_numpy_percentile(spark, buckets):
    rng = np.random.default_rng(11)
    g = rng.integers(0, 4, 900)
    v = np.round(rng.lognormal(2, 1.0, 900), 2)
    v[g == 3] = 7.0                                   # one constant group
    v[:50] = 1e6                                      # a far outlier cluster
    rows = [(int(a), float(b)) for a, b in zip(g, v)] + [(1, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in
           exact_quantiles(df, "v", ["g"], PROBS, buckets=buckets).collect()}
    for key in range(4):
        want = np.percentile(v[g == key], [25, 50, 75])
        assert got[key] == pytest.approx(tuple(want), rel=1e-12)


def test_weighted_rows_equal_expanded_rows(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 30, 400).astype(float)
    df = spark.createDataFrame([(0, float(x)) for x in vals], "g int, v double")
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    got = exact_quantiles(counted, "v", ["g"], PROBS, weight="w", buckets=4).first()
    assert (got.q0, got.q1, got.q2) == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])))


def test_single_row_group(spark):
    df = spark.createDataFrame([(0, 4.0)], "g int, v double")
    r = exact_quantiles(df, "v", ["g"], PROBS).first()
    assert (r.q0, r.q1, r.q2) == (4.0, 4.0, 4.0)


def test_hot_group_refines_exactly(spark):
    """One group holds a third of all rows with continuous values; its
    quartiles come from several refinement levels."""
    rng = np.random.default_rng(21)
    hot = rng.normal(50, 10, 1500)
    cold = rng.normal(0, 1, 3000)
    rows = [(0, float(v)) for v in hot] + [(1 + i % 30, float(v)) for i, v in enumerate(cold)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(8)
    got = {r.g: (r.q0, r.q1, r.q2) for r in
           exact_quantiles(df, "v", ["g"], PROBS, buckets=64).collect()}
    assert got[0] == pytest.approx(tuple(np.percentile(hot, [25, 50, 75])), rel=1e-12)
    for g in range(1, 31):
        vals = np.array([v for gg, v in rows if gg == g])
        assert got[g] == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])), rel=1e-12)


@pytest.mark.parametrize("buckets", [1024, 8])
def test_any_doubles_in_few_passes(spark, monkeypatch, buckets):
    """From denormals to 1e308 on both sides of zero."""
    from surveyspark.operators import quantiles

    passes = []
    refine = quantiles._refine
    monkeypatch.setattr(quantiles, "_refine", lambda *a: passes.append(1) or refine(*a))
    exps = np.linspace(-323, 308, 40)
    v = np.concatenate([[0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], 10.0**exps, -(10.0**exps)])
    df = spark.createDataFrame([(0, float(x)) for x in v] + [(1, float(x)) for x in v[:2]], "n int, v double")
    got = {r.n: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, "v", ["n"], PROBS, buckets=buckets).collect()}
    ranked = np.sort(v)
    for q, p in zip(got[0], PROBS):
        at = p * (len(v) - 1)
        low, high = ranked[int(np.floor(at))], ranked[int(np.ceil(at))]
        assert q == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)
    assert got[1] == (0.0, 0.0, 0.0)
    assert len(passes) <= (11 if buckets == 1024 else 40)


def test_nan_counts_as_missing_and_empty_input_gives_no_rows(spark):
    df = spark.createDataFrame([(0, float("nan")), (0, 1.0), (0, None)], "g int, v double")
    assert exact_quantiles(df, "v", ["g"], PROBS).first()[:] == (0, 1.0, 1.0, 1.0)
    assert exact_quantiles(df.limit(0), "v", ["g"], PROBS).count() == 0
