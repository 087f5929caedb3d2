"""Plan-level helpers.

* ``written`` -- evaluate a DataFrame once into Parquet on the shared folder
  named by ``spark.checkpoint.dir`` and read it back: later scans prune columns
  and take pushed filters, lost executors lose nothing, and the folder goes when
  the session's work ends (``drop_written`` or interpreter exit);
* ``data_version`` -- length and modification time of a table's files, so that
  results kept per table are dropped when its data changes;
* ``plan_text`` -- the formatted physical plan, for tests that assert
  pushdown, pruning and join strategy.

No function here chooses an algorithm by size: broadcasting is left to the
optimizer and AQE, which measure a side before they copy it; the library only
hints sides whose row count is fixed by construction.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """Physical plan as text (``df.explain`` prints; this returns)."""
    sc = df.sparkSession.sparkContext
    return sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a
    local master, whose executors are this machine, gets a scratch folder when
    none is set; elsewhere the setting is demanded."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="surveyspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


_written: set[tuple[str, str]] = set()  # (application, folder) to remove at the end


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A name on the shared folder that ``drop_folder`` or the end removes."""
    folder = f"{shared_folder(spark)}/surveyspark-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_written)
    _written.add((spark.sparkContext.applicationId, folder))
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete what was written under a name of ``new_folder``."""
    _delete(spark, folder)
    _written.discard((spark.sparkContext.applicationId, folder))


def written(df: DataFrame) -> DataFrame:
    """``df`` evaluated once into Parquet on the shared folder and read back."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def drop_written(df: DataFrame | None = None) -> None:
    """Delete what ``written`` left: the files behind ``df``, or all of them.
    DataFrames that still read them stop working."""
    spark = df.sparkSession if df is not None else SparkSession.getActiveSession()
    for entry in list(_written):
        app, folder = entry
        name = folder.rsplit("/", 1)[1]
        if df is not None and not any(name in f for f in df.inputFiles()):
            continue
        try:
            if spark is not None and spark.sparkContext.applicationId == app:
                _delete(spark, folder)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            pass
        _written.discard(entry)


def data_version(spark: SparkSession, paths: list[str]) -> str:
    """Number, and sums over hashes of path, length and modification time, of all
    files under ``paths``. The files are listed by Spark as a table and not opened;
    one row reaches the driver's Python."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
             .select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")))
    found = files.agg(F.count("h").alias("n"), F.sum("h").alias("h"), F.sum(F.col("h") % 999_999_937).alias("r")).first()
    return repr(tuple(found))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, so
    that functions from its modules load there without an installation."""
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
