"""SparkSession construction for local runs (tests, bench, examples).

On a cluster the session comes from the platform; the library itself never
sets cluster-level paths. ``spark.checkpoint.dir`` is read from the session
and only filled in here, for local runs, when it is unset.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .plans import shared_folder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "surveyspark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SURVEYSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; see ``plans.shared_folder``."""
    return shared_folder(spark)
