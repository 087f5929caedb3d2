"""The ``survey`` stand-in: one wide, coded row per ``lineitem`` row.

The analysed data set is a wide activity-level survey file: a packed case
id whose digits hold year and month, a numeric label, durations, and small
integer answer codes where negative codes stand for "no answer". The test
tables carry no such file, so ``survey`` derives one from the star schema
(definition in FIXTURES.md section B). The DataFrame below and
``SURVEY_SQL`` are two independent spellings of the same definition; the
SQL one feeds the DuckDB oracle.

Plan notes: column pruning keeps only the 17 source columns needed; the
optimizer and AQE broadcast sides they measure as small and sort-merge the rest.
``survey_table`` writes the joined rows once per session as Parquet, as the one
wide file the analysis starts from: every later query prunes columns and pushes
its cleaning rules into that scan, and the four-table join runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import data_version, written
from .tables import read_table, table_path

# Row key: unique at sf0.01 and sf0.1 (one duplicate at sf0.001).
SURVEY_KEY = ["l_orderkey", "activity_n", "l_partkey", "l_suppkey"]

LABEL = "bmi"

# Model features of the stand-in, in the order the analysed feature list
# maps onto it (durations, codes, age, ...). ``activity_n`` is kept as a
# column but not used as a feature: once ``exfreq = -1`` rows are cleaned
# out, ``exfreq`` equals ``activity_n`` on every row of the stand-in, and an
# exact duplicate makes unregularised least squares ill-posed.
MODEL_FEATURES = ["prim_min", "sec_min", "soda", "exercise", "age", "income",
                  "exfreq", "loc", "sex"]

# Columns kept by the cleaning step (label first, then features).
CLEAN_COLUMNS = [LABEL] + MODEL_FEATURES + ["activity_n"]


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    cust = read_table(spark, sf_dir, "customer",
                      ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])

    # orders x customer first: on the sort-merge path the custkey shuffle moves
    # orders-sized rows and lineitem-sized rows are shuffled twice; small sides
    # are broadcast in this order as well
    oc = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    j = (li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
           .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return j.select(*_survey_columns())


_tables: dict[tuple[str, str], tuple[str, DataFrame]] = {}  # data version and table


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """Changes when a source table's files do."""
    return data_version(spark, [table_path(sf_dir, t) for t in ("lineitem", "orders", "part", "customer")])


def survey_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``survey`` as a written table; built again when a source changes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    version = source_version(spark, sf_dir)
    if key not in _tables or _tables[key][0] != version:
        _tables[key] = (version, written(survey(spark, sf_dir)))
    return _tables[key][1]


def forget_tables() -> None:
    """The next query writes its survey table anew."""
    _tables.clear()


def _survey_columns() -> list[Column]:
    c = F.col
    ship = c("l_shipdate")
    case_id = (F.year(ship).cast("bigint") * F.lit(10_000_000_000)
               + F.month(ship).cast("bigint") * F.lit(100_000_000)
               + F.dayofmonth(ship).cast("bigint") * F.lit(1_000_000)
               + c("l_orderkey") % F.lit(1_000_000))
    bmi = (F.when(c("l_discount") == 0, F.lit(-1.0))
            .otherwise(F.lit(18.0) + F.lit(0.2) * c("l_quantity")
                       + F.lit(30.0) * c("l_discount")
                       + ((c("l_orderkey") * 7919 + c("l_partkey")) % 100) / F.lit(25.0)))
    sec_min = F.when(c("l_quantity") > 40, F.lit(-1.0)).otherwise(c("l_quantity") * 3)
    soda = (F.when(c("l_tax") == 0, -2).when(c("l_returnflag") == "A", 1)
             .when(c("l_returnflag") == "N", 2).otherwise(3))
    exercise = (F.when(c("p_size") <= 2, -1).when(c("l_linestatus") == "O", 1).otherwise(2))
    income = (F.when(c("o_orderpriority") == "1-URGENT", 1)
               .when(c("o_orderpriority") == "2-HIGH", 2)
               .when(c("o_orderpriority") == "3-MEDIUM", 3).otherwise(-1))
    exfreq = F.when(c("l_linenumber") == 1, -1).otherwise(c("l_linenumber"))
    earn = (F.when(c("l_linenumber") == 7, F.lit(None).cast("double"))
             .when(c("c_acctbal") < 0, F.lit(-1.0)).otherwise(c("c_acctbal")))
    sex = F.when(c("c_mktsegment").isin("MACHINERY", "BUILDING"), 1).otherwise(2)
    return [
        case_id.alias("case_id"),
        c("l_orderkey"), c("l_partkey"), c("l_suppkey"),
        c("l_linenumber").alias("activity_n"),
        bmi.alias("bmi"),
        c("l_quantity").alias("prim_min"),
        sec_min.alias("sec_min"),
        soda.cast("int").alias("soda"),
        exercise.cast("int").alias("exercise"),
        income.cast("int").alias("income"),
        exfreq.cast("int").alias("exfreq"),
        (c("p_size") + 15).cast("int").alias("age"),
        c("c_nationkey").cast("int").alias("loc"),
        earn.alias("earn"),
        sex.cast("int").alias("sex"),
    ]


# Fixed definition shared with the oracle (FIXTURES.md section B).
SURVEY_SQL = """
select
  year(l_shipdate)*10000000000 + month(l_shipdate)*100000000
    + day(l_shipdate)*1000000 + l_orderkey % 1000000          as case_id,
  l_orderkey, l_partkey, l_suppkey, l_linenumber              as activity_n,
  case when l_discount = 0 then -1E0
       else 18E0 + 2E-1*l_quantity + 3E1*l_discount
            + ((l_orderkey*7919 + l_partkey) % 100)/25E0 end  as bmi,
  l_quantity                                                  as prim_min,
  case when l_quantity > 40 then -1E0 else l_quantity*3 end   as sec_min,
  case when l_tax = 0 then -2 when l_returnflag = 'A' then 1
       when l_returnflag = 'N' then 2 else 3 end              as soda,
  case when p_size <= 2 then -1
       when l_linestatus = 'O' then 1 else 2 end              as exercise,
  case when o_orderpriority = '1-URGENT' then 1
       when o_orderpriority = '2-HIGH' then 2
       when o_orderpriority = '3-MEDIUM' then 3 else -1 end   as income,
  case when l_linenumber = 1 then -1 else l_linenumber end    as exfreq,
  p_size + 15                                                 as age,
  c_nationkey                                                 as loc,
  case when l_linenumber = 7 then null
       when c_acctbal < 0 then -1E0 else c_acctbal end        as earn,
  case when c_mktsegment in ('MACHINERY','BUILDING')
       then 1 else 2 end                                      as sex
from lineitem
join orders   on l_orderkey = o_orderkey
join part     on l_partkey  = p_partkey
join customer on o_custkey  = c_custkey
"""


def with_survey(sql: str) -> str:
    """Prefix an oracle query with the ``survey`` CTE."""
    return f"with survey as ({SURVEY_SQL})\n{sql}"
