"""The streaming monthly means end where the batch table is."""

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import monthly
from surveyspark.sources import survey
from surveyspark.streaming import read_survey_stream, start_monthly_mean

from .conftest import SF_SMALL


def test_stream_matches_batch(spark, scratch):
    src = survey(spark, SF_SMALL).select("case_id", "exfreq")
    landing = f"{scratch}/landing"
    # land the data as several files, one per shipping year
    years = [r.y for r in src.select((F.col("case_id") / 10_000_000_000).cast("int").alias("y"))
             .distinct().collect()]
    for y in sorted(years):
        (src.where((F.col("case_id") / 10_000_000_000).cast("int") == y)
            .coalesce(1).write.mode("append").parquet(landing))
    stream = read_survey_stream(spark, landing, src.schema, max_files_per_trigger=1)
    q = start_monthly_mean(stream, "case_id", ["exfreq"], f"{scratch}/ckpt",
                           query_name="monthly_mean_test")
    try:
        q.processAllAvailable()
        got = {(r.year, r.month): (r.rows, r.mean_exfreq)
               for r in spark.sql("select * from monthly_mean_test").collect()}
    finally:
        q.stop()
    want = {(r.year, r.month): (r.rows, r.mean_exfreq)
            for r in monthly.monthly_mean(monthly.with_calendar(src, "case_id"), ["exfreq"])
            .collect()}
    assert got.keys() == want.keys()
    for k, (n, m) in want.items():
        assert got[k][0] == n
        assert got[k][1] == pytest.approx(m)
