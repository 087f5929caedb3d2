"""Readers for the input tables.

Parquet is the native format: Catalyst prunes columns and pushes filters
into the scan, so readers never ``select *`` on behalf of the caller.
CSV is supported with a declared schema (the reference reads one merged
CSV); ``inferSchema`` is an opt-in fallback because it costs a full pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one parquet table; ``columns`` narrows the scan's ReadSchema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, infer: bool = False) -> DataFrame:
    """Read a delimited file with a header row.

    Pass ``schema`` (a ``StructType`` or DDL string) so ids stay ``bigint``:
    an inferred double id prints as ``2.014...E13`` and breaks the calendar
    substrings. ``infer=True`` falls back to schema inference.
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write with a header row; used to round-trip the CSV source in tests."""
    df.write.mode("overwrite").option("header", True).csv(path)
