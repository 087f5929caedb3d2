"""Property tests for the two custom exact algorithms: random small inputs,
brute-force answers (numpy percentile, a full sort)."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.operators import split as sp
from surveyspark.operators.quantiles import exact_quantiles

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50)), min_size=1, max_size=60)


@SETTINGS
@given(rows=values, buckets=st.integers(4, 64))
def test_quantiles_property(spark, rows, buckets):
    df = spark.createDataFrame([(g, v / 4.0) for g, v in rows], "g int, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in
           exact_quantiles(df, "v", ["g"], [0.1, 0.5, 0.9], buckets=buckets).collect()}
    for g in {g for g, _ in rows}:
        vals = np.array([v / 4.0 for gg, v in rows if gg == g])
        assert got[g] == pytest.approx(tuple(np.percentile(vals, [10, 50, 90])), abs=1e-12)


@SETTINGS
@given(keys=st.lists(st.integers(0, 10_000), min_size=1, max_size=80),
       fraction=st.floats(0.0, 1.0), buckets=st.integers(2, 64))
def test_exact_split_property(spark, keys, fraction, buckets):
    df = spark.createDataFrame([(k, (k * 31) % 17) for k in keys], "k long, o long")
    out = sp.with_exact_split(df, fraction, "o", ["k"], buckets=buckets)
    got = sorted(r.k for r in out.where(F.col("split") == "test").collect())
    ordered = sorted(((k * 31) % 17, k) for k in keys)
    m = math.ceil(fraction * len(keys))
    assert got == sorted(k for _, k in ordered[:m])
