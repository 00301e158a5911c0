"""Tables and folders in the place that the cluster shares, which go when the driver ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local() -> str:
    folder = tempfile.mkdtemp(prefix="sievework-files-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str = "files") -> str:
    """A new path in the folder that spark.checkpoint.dir names, removed when the driver ends.

    Under a local master without that setting, a temporary folder.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(shared or _local()).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at, fs = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows, written to a new shared table and read back: what builds on it doesn't compute it again."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
