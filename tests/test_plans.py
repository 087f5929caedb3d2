"""Plan shape: pushdown and pruning reach the scan of the written table, no
shuffle of values, no Python UDF in the hot path, nothing left behind."""

from pyspark.sql import functions as F

from surveyspark import catalog as C
from surveyspark.functions import drop_codes, keep_codes
from surveyspark.plans import data_version, drop_written, plan_text, shared_folder, written
from surveyspark.sources import read_table

from .conftest import SF_SMALL


def test_keep_null_deny_list_is_pushed_to_parquet(spark):
    df = read_table(spark, SF_SMALL, "lineitem", ["l_orderkey", "l_linenumber"])
    plan = plan_text(df.where(drop_codes("l_linenumber", [1, 2])))
    assert "PushedFilters: [Or(IsNull(l_linenumber)" in plan
    plan = plan_text(df.where(keep_codes("l_linenumber", [1, 2])))
    assert "PushedFilters: [In(l_linenumber, [1,2])]" in plan


def test_survey_scan_reads_only_needed_columns(spark):
    from surveyspark.sources import survey

    # the join that builds the table reads the needed source columns only
    plan = plan_text(survey(spark, SF_SMALL))
    li = [line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert li and all("l_extendedprice" not in line for line in li)
    # and a query reads its own columns of the table
    plan = plan_text(C.q_case_calendar(spark, SF_SMALL))
    assert "ReadSchema: struct<case_id:bigint>" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_grouping_sets_single_aggregate(spark):
    plan = plan_text(C.q_monthly_mean_grouping_sets(spark, SF_SMALL), "simple")
    assert "Expand" in plan
    assert plan.count("HashAggregate(") == 2          # partial + final, one shuffle


def test_cleaning_rules_reach_the_scan(spark):
    plan = plan_text(C.q_clean_survey(spark, SF_SMALL))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for rule in ("Not(EqualTo(bmi,-1.0))", "In(soda, [1,2,3])", "In(exercise, [1,2])", "In(income, [1,2,3])",
                 "Not(EqualTo(exfreq,-1))", "Not(EqualTo(loc,-1))"):
        assert rule in pushed.replace("Not(In(exfreq, [-1]))", "Not(EqualTo(exfreq,-1))"), (rule, pushed)
    assert "Join" not in plan and "Exchange" not in plan


def test_fits_read_few_columns(spark):
    train, _ = C.train_test(spark, SF_SMALL)
    plan = plan_text(train.select("prim_min", "bmi"))
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    read = {part.split(":")[0].split("<")[-1] for part in schema.split("struct<")[1].split(",")}
    # label and feature, the cleaning rules' columns and the row key
    assert read == {"bmi", "prim_min", "soda", "exercise", "income", "exfreq", "loc",
                    "l_orderkey", "activity_n", "l_partkey", "l_suppkey"}


def test_one_join_per_session(spark):
    first = C.survey_table(spark, SF_SMALL)
    assert C.survey_table(spark, SF_SMALL) is first
    plan = plan_text(C.q_correlation_pairs(spark, SF_SMALL))
    assert "Join" not in plan and "lineitem" not in plan


def test_written_prunes_and_is_removed(spark):
    out = written(spark.range(100).selectExpr("id", "id * 2 x", "'a' y"))
    assert "ReadSchema: struct<x:bigint>" in plan_text(out.select("x")) and out.count() == 100
    files = out.inputFiles()
    assert all(shared_folder(spark).split(":")[-1] in f for f in files)
    drop_written(out)
    import os
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_data_version_follows_the_files(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/t")
    before = data_version(spark, [f"{scratch}/t"])
    assert data_version(spark, [f"{scratch}/t"]) == before
    spark.range(4).write.mode("append").parquet(f"{scratch}/t")
    assert data_version(spark, [f"{scratch}/t"]) != before


def _exchanges(plan):
    return [line for line in plan.splitlines() if "hashpartitioning" in line]


def test_box_stats_and_describe_shuffle_no_values(spark):
    for q in (C.q_box_stats_by_code, C.q_box_stats_by_sex, C.q_describe_numeric):
        plan = plan_text(q(spark, SF_SMALL), "simple")
        assert "PythonUDF" not in plan
        for line in _exchanges(plan):
            assert not any(f"{c}#" in line for c in ("_x", "_v", "value", "bmi")), line


def test_quantile_passes_shuffle_only_bucket_counts(spark, monkeypatch):
    from surveyspark.operators import quantiles

    plans = []
    refine = quantiles._refine
    monkeypatch.setattr(quantiles, "_refine", lambda *a: plans.append(plan_text(refine(*a), "simple")) or refine(*a))
    C.q_box_stats_by_code(spark, SF_SMALL)
    assert plans
    for plan in plans:
        assert not any("_v#" in line for line in _exchanges(plan))


def test_survey_join_order_without_broadcast(spark):
    """At scale (no side broadcastable) lineitem-sized rows are shuffled only
    by orderkey and partkey; the custkey join runs on orders-sized rows."""
    from surveyspark.sources import survey
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(survey(spark, SF_SMALL), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in exchanges]
    assert plan.count("SortMergeJoin") == 3
    assert sorted(keys) == sorted(["l_orderkey", "o_orderkey", "l_partkey", "p_partkey",
                                   "o_custkey", "c_custkey"])


def test_survey_broadcasts_small_sides(spark):
    from surveyspark.sources import survey
    plan = plan_text(survey(spark, SF_SMALL), "simple")
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
