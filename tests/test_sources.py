"""Sources: the survey view and the CSV reader with a declared schema."""

import os

import pytest

from surveyspark.functions import case_month, case_year
from surveyspark.sources import delimited, read_csv, read_table, scan_csv, survey, write_csv

from .conftest import SF_SMALL


def test_survey_schema_and_rows(spark):
    df = survey(spark, SF_SMALL)
    types = dict(df.dtypes)
    assert types["case_id"] == "bigint" and types["bmi"] == "double"
    assert types["soda"] == "int" and types["earn"] == "double"
    assert df.count() == read_table(spark, SF_SMALL, "lineitem").count()


def test_csv_round_trip_keeps_bigint_ids(spark, scratch):
    src = survey(spark, SF_SMALL).select("case_id", "bmi", "exfreq")
    path = f"{scratch}/survey_csv"
    write_csv(src, path)
    back = read_csv(spark, path, schema="case_id bigint, bmi double, exfreq int")
    assert back.count() == src.count()
    a = src.select(case_year("case_id"), case_month("case_id")).distinct().count()
    b = back.select(case_year("case_id"), case_month("case_id")).distinct().count()
    assert a == b
    inferred = read_csv(spark, path, infer=True)
    assert dict(inferred.dtypes)["case_id"] in ("bigint", "int", "long")


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_infers_types_from_all_rows(spark, scratch):
    late = "\n".join(["1,2,true,2020-01-02,2020-01-02 03:04:05,7,,x y"] * 500)
    put(scratch, "a.csv", "i,d,b,day,at,big,none,s\n" + late + '\n-5,2.5e3,FALSE,2020-02-29,2020-01-02T03:04:05,99999999999999999999,,"a,b"\n')
    scan = scan_csv(spark, scratch)
    assert scan.types == {"i": "bigint", "d": "double", "b": "boolean", "day": "date", "at": "timestamp",
                          "big": "string", "none": "string", "s": "string"}
    assert dict(scan.kept.dtypes) == scan.types
    assert scan.kept.count() == 501 and scan.quarantine.count() == 0
    last = scan.kept.where("i = -5").first()
    assert (last["d"], last["b"], str(last["day"]), last["big"], last["none"], last["s"]) == (
        2500.0, False, "2020-02-29", "99999999999999999999", None, "a,b")


def test_scan_quarantines_every_line_once(spark, scratch):
    good = "".join(f"{i},{i / 4},n{i}\n" for i in range(200))
    put(scratch, "a.csv", "id,x,name\n" + good + "7,oops,z\n8,1.5\n\n")
    put(scratch, "b.csv", "id,x,name\n9,1,a,b\n1e,zz,q\n10,NaN,\n")
    scan = scan_csv(spark, scratch, min_share=0.9)
    assert scan.types == {"id": "bigint", "x": "double", "name": "string"}
    bad = {r["line"]: (r["file"].rsplit("/", 1)[1], r["reason"], r["columns"]) for r in scan.quarantine.collect()}
    assert bad == {"7,oops,z": ("a.csv", "values", ["x"]), "8,1.5": ("a.csv", "fields", []),
                   "9,1,a,b": ("b.csv", "fields", []), "1e,zz,q": ("b.csv", "values", ["id", "x"])}
    assert scan.kept.count() == 201
    # which rows are kept does not depend on the columns read
    for name in scan.kept.columns:
        assert scan.kept.select(name).count() == 201 == len(scan.kept.select(name).collect())
    # the strict rule turns a column with one odd value into text instead
    strict = scan_csv(spark, scratch)
    assert strict.types == {"id": "string", "x": "string", "name": "string"}
    assert strict.kept.count() == 203 and {r["reason"] for r in strict.quarantine.collect()} == {"fields"}


def test_scan_edges(spark, scratch):
    put(f"{scratch}/header", "a.csv", "a,_line,b c\n")
    scan = scan_csv(spark, f"{scratch}/header")
    assert scan.kept.columns == ["a", "_line", "b c"] and scan.kept.count() == 0 == scan.quarantine.count()
    put(f"{scratch}/empty", "a.csv", "")
    with pytest.raises(ValueError, match="header"):
        scan_csv(spark, f"{scratch}/empty")
    put(f"{scratch}/lines", "a.csv", 'a;b\n1;"x\ny"\n2;-\n')
    scan = scan_csv(spark, f"{scratch}/lines", sep=";", multi_line=True, null_value="-")
    assert [tuple(r) for r in scan.kept.orderBy("a").collect()] == [(1, "x\ny"), (2, None)]
    put(f"{scratch}/differ", "a.csv", "a,b\n1,2\n")
    put(f"{scratch}/differ", "b.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, f"{scratch}/differ")


def test_kinds_are_worked_out_once_a_cell(spark, monkeypatch):
    made = []
    kind = delimited._kind
    monkeypatch.setattr(delimited, "_kind", lambda value: made.append(value) or kind(value))
    rows = [("1", "1.5", None, "x", "2020-01-02")] * 9 + [("2", "7", None, "true", "no")]
    strings = spark.createDataFrame(rows, "a string, `b c` string, n string, s string, d string")
    assert delimited.infer_types(strings, 0.9) == {"a": "bigint", "b c": "double", "n": "string", "s": "string", "d": "date"}
    assert len(made) == 1  # one expression for all columns and counts, not one for each
