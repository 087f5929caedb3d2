"""Profiling and cleaning on small hand-made frames with planted nulls."""

import numpy as np
import pytest

from surveyspark.operators import cleaning as cl
from surveyspark.operators import profiling


@pytest.fixture()
def coded(spark):
    rows = [(1, 1.0, -1), (2, 2.0, 1), (3, None, 2), (4, 4.0, -1), (5, -1.0, None),
            (6, 6.0, 2), (7, None, 3)]
    return spark.createDataFrame(rows, "id int, v double, code int")


def test_column_profile_counts_nulls(coded):
    out = {r.column_name: r for r in profiling.column_profile(coded).collect()}
    assert out["v"].rows == 7 and out["v"].non_null == 5 and out["v"].null_count == 2
    assert out["code"].non_null == 6 and out["code"].data_type == "int"
    assert [r.position for r in sorted(out.values(), key=lambda r: r.position)] == [0, 1, 2]


def test_describe_matches_numpy(coded):
    r = {x.column_name: x for x in profiling.describe_numeric(coded, ["v"]).collect()}["v"]
    vals = np.array([1.0, 2.0, 4.0, -1.0, 6.0])
    assert r["count"] == 5
    assert r["mean"] == pytest.approx(vals.mean())
    assert r["std"] == pytest.approx(vals.std(ddof=1))
    assert (r.p25, r.p50, r.p75) == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])))
    assert (r["min"], r["max"]) == (-1.0, 6.0)


def test_value_counts_null_group_and_ties(coded):
    with_null = [(r.code, r.n) for r in profiling.value_counts(coded, "code", dropna=False)
                 .collect()]
    # counts descending, ties by value with the missing group first
    assert with_null == [(-1, 2), (2, 2), (None, 1), (1, 1), (3, 1)]
    no_null = [(r.code, r.n) for r in profiling.value_counts(coded, "code").collect()]
    assert (None, 1) not in no_null and len(no_null) == 4


def test_sentinel_share(coded):
    out = {r.column_name: r for r in profiling.sentinel_share(coded, {"code": [-1], "v": [-1]})
           .collect()}
    assert out["code"].sentinel_rows == 2 and out["code"].non_null == 6
    assert out["code"].pct == pytest.approx(100 * 2 / 6)
    assert out["v"].pct == pytest.approx(100 * 1 / 5)


def test_rules_keep_and_drop_semantics(coded):
    rules = [cl.drop("v", -1), cl.keep("code", 1, 2)]
    ids = sorted(r.id for r in cl.apply_rules(coded, rules).collect())
    # v null kept by the deny-list; code null dropped by the allow-list
    assert ids == [2, 3, 6]


def test_funnel_is_monotone_and_matches_filters(coded):
    rules = [cl.drop("v", -1), cl.drop("code", -1), cl.keep("code", 1, 2, 3)]
    steps = [r.rows_left for r in cl.cleaning_funnel(coded, rules).orderBy("step").collect()]
    assert steps[0] == 7
    assert steps == sorted(steps, reverse=True)
    for i in range(1, len(rules) + 1):
        assert steps[i] == cl.apply_rules(coded, rules[:i]).count()


def test_drop_sentinel_keep_null_switch(coded):
    assert cl.drop_sentinel(coded, "v", -1).count() == 6
    assert cl.drop_sentinel(coded, "v", -1, keep_null=False).count() == 4


def test_describe_all_null_and_single_value_columns(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    out = {r.column_name: r for r in profiling.describe_numeric(df, ["a", "b"]).collect()}
    assert out["a"]["count"] == 0 and out["a"].mean is None and out["a"].p50 is None
    assert out["b"]["count"] == 2 and out["b"].std == 0.0 and out["b"].p25 == 3.0
