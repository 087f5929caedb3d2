"""Every registered query with a SQL twin agrees with DuckDB (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from surveyspark.catalog import QUERIES
from surveyspark.sources import TABLES, table_path
from tools.check_oracle import digest

from .conftest import SF_SMALL

KEYS = sorted(k for k in E.oracle_sql() if k in QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def test_every_query_is_registered_with_oracle_or_rows_only():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    rows_only = set(QUERIES) - set(orc)
    assert rows_only == {"forest_best_importances", "forest_rmse",
                         "forest_importances", "forest_cv", "forest_topk",
                         "forest_generalisation_ratio", "importance_vs_coefficient"}


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_duckdb(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows) == digest(dcols, drows)


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "month", "level", "rows", "mean_exfreq"]
    rows = df.collect()
    assert len(rows) > 0
    levels = {r.level for r in rows}
    assert levels == {0, 2}
    # all-years rows have no year; their counts add up to the per-year rows
    per_month = {}
    for r in rows:
        if r.level == 0:
            per_month[r.month] = per_month.get(r.month, 0) + r.rows
    assert all(per_month[r.month] == r.rows for r in rows if r.level == 2)
