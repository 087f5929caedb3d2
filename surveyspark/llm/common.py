"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master (tests)
    gets a scratch folder; any other session without the setting is refused,
    because executors could not read a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="surveyspark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared checkpoint folder (reliable: a lost
    executor does not lose it). The files go when the session's context cleaner
    drops the reference (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application,
    so that functions from its modules load there without an installation."""
    sc = spark.sparkContext
    if getattr(sc, "_surveyspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="surveyspark-py-")) / "surveyspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._surveyspark_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str,
                rows: int = 1000) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows.

    ``fn`` gets one slice and yields dicts of column lists or arrays in the
    order of ``schema``; a task holds one Arrow batch and one slice at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for cols in fn(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, target)
