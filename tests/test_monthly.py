"""Monthly means: one-year filter, all-years table, grouping sets."""

import pytest

from surveyspark.operators import monthly
from surveyspark.operators import split as sp


@pytest.fixture()
def cases(spark):
    rows = [(20140105000001, 2), (20140120000002, 4), (20140201000003, -1),
            (20150110000004, 6), (20150215000005, None), (None, 9)]
    return monthly.with_calendar(spark.createDataFrame(rows, "id bigint, x int"), "id")


def test_one_year_filter(cases):
    out = {r.month: (r.rows, r.mean_x) for r in monthly.monthly_mean(cases, ["x"], year="2014")
           .collect()}
    assert out == {"01": (2, 3.0), "02": (1, -1.0)}


def test_sentinels_kept_unless_excluded(cases):
    raw = {r.month: r.mean_x for r in monthly.monthly_mean_all_years(cases, ["x"]).collect()}
    assert raw["02"] == -1.0            # 2014-02 holds -1; 2015-02 holds a null
    excl = {r.month: r.mean_x for r in
            monthly.monthly_mean_all_years(cases, ["x"], exclude={"x": [-1]}).collect()}
    assert excl["02"] is None and excl["01"] == 4.0


def test_grouping_sets_equal_separate_tables(cases):
    gs = monthly.monthly_mean_grouping_sets(cases, ["x"]).collect()
    per_year = {(r.year, r.month): r.mean_x for r in monthly.monthly_mean(cases, ["x"]).collect()}
    overall = {r.month: r.mean_x for r in monthly.monthly_mean_all_years(cases, ["x"]).collect()}
    assert {(r.year, r.month): r.mean_x for r in gs if r.level == 0} == per_year
    assert {r.month: r.mean_x for r in gs if r.level == 2} == overall
    assert all(r.month is not None for r in gs)      # null month is not a group


def test_seeded_random_folds_cover_unit_interval(spark):
    df = sp.with_random_folds(spark.range(3000), 3, seed=7)
    counts = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == 3000
    # same seed, same partitioning: same assignment
    again = sp.with_random_folds(spark.range(3000), 3, seed=7)
    first = {r.id: r.fold for r in df.collect()}
    assert first == {r.id: r.fold for r in again.collect()}
