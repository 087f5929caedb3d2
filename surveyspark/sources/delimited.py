"""Delimited files of unknown types, with a quarantine table.

``scan_csv`` reads files that have a header row and nothing declared: one pass
over all rows infers each column's type, one pass parses the rows into Parquet on
the shared folder. Rows that do not fit (another number of fields, or a value that
is not of its column's type) are kept as raw lines beside the reason, so that
every line of the files is in exactly one of the two tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import written

# Types tried, narrowest first, and the spelling each demands beside a valid cast.
SPELLINGS = {
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|-?Inf|[+-]?Infinity)$",
    "boolean": r"^(?i)(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$",
}


class CsvScan(NamedTuple):
    """``kept``: the typed rows. ``quarantine``: ``file, line, reason, columns``, with
    reason 'fields' (wrong number of fields; no columns named) or 'values' (the
    columns whose value is not of the type). ``types``: inferred type per column."""

    kept: DataFrame
    quarantine: DataFrame
    types: dict[str, str]


def _kind(value: Column) -> Column:
    """The narrowest type a value fits, null for text. Whole numbers beyond 64 bits
    are text: as doubles they would lose digits."""
    kind = F.when(value.rlike(SPELLINGS["bigint"]), F.when(value.try_cast("bigint").isNotNull(), "bigint"))
    for name in ("double", "boolean", "date", "timestamp"):
        kind = kind.when(value.rlike(SPELLINGS[name]), F.when(value.try_cast(name).isNotNull(), name)
                         if name in ("date", "timestamp") else F.lit(name))
    return kind


def infer_types(strings: DataFrame, min_share: float = 1.0) -> dict[str, str]:
    """Type per string column, from all rows in one aggregate (at most six counts a
    column reach the driver): the type that fits most non-null values, the narrowest of
    equals, if it fits at least ``min_share`` of them; else string, as is a column
    without any value. A whole number also fits double."""
    if not 0 < min_share <= 1:
        raise ValueError("min_share must lie in (0, 1]")
    # one row a cell: the kind is worked out once, however many counts need it
    cells = strings.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{name}`").alias("value"))
                                              for i, name in enumerate(strings.columns)])))
    counts = (cells.where(F.col("value").isNotNull()).groupBy("at", _kind(F.col("value")).alias("kind"))
                   .agg(F.count(F.lit(1)).alias("n")))
    found = {(r["at"], r["kind"]): r["n"] for r in counts.collect()}
    types = {}
    for i, name in enumerate(strings.columns):
        fits = {kind: found.get((i, kind), 0) for kind in SPELLINGS}
        values = sum(fits.values()) + found.get((i, None), 0)
        fits["double"] += fits["bigint"]
        best = max(fits, key=fits.get)  # the first of equals
        types[name] = best if values and fits[best] >= min_share * values else "string"
    return types


def scan_csv(spark: SparkSession, path: str, min_share: float = 1.0, sep: str = ",",
             multi_line: bool = False, null_value: str = "") -> CsvScan:
    """Typed rows and quarantined lines of the files under ``path``.

    Every file has the same header row (files whose headers differ are refused).
    ``min_share`` below 1 lets a column keep its type although some of its values do
    not fit; those rows are quarantined. ``multi_line`` reads quoted line breaks (a
    file is then one task's work). Blank lines are skipped; ``null_value`` is read as
    null, and an empty field always. Files with a header only give empty tables.
    """
    options = {"header": True, "sep": sep, "multiLine": multi_line, "nullValue": null_value}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        raise ValueError(f"no header row under {path}")
    raw, file, again = "_line", "_file", "_text"
    while {raw, file, again} & set(names):
        raw, file, again = "_" + raw, "_" + file, "_" + again

    def schema(types: dict[str, str]) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in (types | {raw: "string"}).items())

    def read(types: dict[str, str]) -> DataFrame:
        return (spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=raw,
                                   enforceSchema=False, columnPruning=False)
                .schema(schema(types)).csv(path))

    text = dict.fromkeys(names, "string")
    types = infer_types(read(text).where(F.col(raw).isNull()).drop(raw), min_share)
    # written whole: which rows are malformed would otherwise depend on the columns a query reads
    rows = written(read(types).withColumn(file, F.input_file_name()))
    strings = F.from_csv(F.col(raw), schema(text), {"mode": "PERMISSIVE", "sep": sep, "nullValue": null_value,
                                                    "multiLine": str(multi_line).lower(),
                                                    "columnNameOfCorruptRecord": raw})
    failed = F.filter(F.array(*[F.when(F.col(again).getField(n).isNotNull() & F.col(f"`{n}`").isNull(), F.lit(n))
                                for n in names]), lambda name: name.isNotNull())
    wrong_length = F.col(again).getField(raw).isNotNull()
    quarantine = (rows.where(F.col(raw).isNotNull()).withColumn(again, strings)
                  .select(F.col(file).alias("file"), F.col(raw).alias("line"),
                          F.when(wrong_length, "fields").otherwise("values").alias("reason"),
                          F.when(wrong_length, F.array().cast("array<string>")).otherwise(failed).alias("columns")))
    return CsvScan(rows.where(F.col(raw).isNull()).drop(raw, file), quarantine, types)
