"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session of one machine, as in tests, gets a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = context._gleaner_folder = getattr(context, "_gleaner_folder", None) or tempfile.mkdtemp(prefix="gleaner")
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in it."""
    return f"{shared_base(spark)}/{name}_{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` from Parquet files in ``path``; what was shuffled to make them is removed."""
    spark, cleanup = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
