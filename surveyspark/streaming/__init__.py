"""Monthly means maintained incrementally over arriving survey files.

The batch ``operators.monthly`` tables, kept current as new files land:
each micro-batch adds its rows' counts and sums per (year, month) to the
state store, and the mean is ``sum / count`` of the running totals. State
holds one row per (year, month) key -- bounded by the calendar, not by the
data -- so no watermark is needed to evict it; output mode ``update`` emits
only the months a batch touched, ``complete`` the whole table.

The checkpoint location must be a shared, durable folder on a cluster (it
carries offsets and state across restarts and executor loss).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.monthly import with_calendar


def read_survey_stream(spark: SparkSession, path: str, schema: StructType | str,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None
                       ) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def monthly_mean_stream(stream: DataFrame, id_col: str, values: Sequence[str]) -> DataFrame:
    """Streaming aggregate: ``year, month, rows, mean_<v>`` per month."""
    cal = with_calendar(stream, id_col).where(F.col("month").isNotNull())
    aggs = [F.count(F.lit(1)).alias("rows")]
    for v in values:
        aggs += [F.sum(F.col(v).cast("double")).alias(f"_sum_{v}"),
                 F.count(F.col(v)).alias(f"_n_{v}")]
    totals = cal.groupBy("year", "month").agg(*aggs)
    return totals.select("year", "month", "rows",
                         *[(F.col(f"_sum_{v}") / F.col(f"_n_{v}")).alias(f"mean_{v}")
                           for v in values])


def start_monthly_mean(stream: DataFrame, id_col: str, values: Sequence[str],
                       checkpoint_location: str, query_name: str = "monthly_mean",
                       sink: str = "memory", output_mode: str = "complete",
                       trigger_seconds: int | None = None) -> StreamingQuery:
    writer = (monthly_mean_stream(stream, id_col, values).writeStream
              .outputMode(output_mode).format(sink).queryName(query_name)
              .option("checkpointLocation", checkpoint_location))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
