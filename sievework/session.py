"""Session factory and small helpers that every module shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE and skew-join handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read with Spark alone, so any store that Spark can reach will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table for work that is dear row by row: dealt anew if it has fewer splits than there are cores, so that
    small tables use them all; tables with more splits stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows
