"""Structured Streaming forms of the resumable logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def once_per_key(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_rates(stream: DataFrame, time: str, by: str, flag: F.Column, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and shares by window and key; rows later than the watermark go."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("share"))


def first_verified_stream(stream: DataFrame, item: str, number: str, ok: str, value: str) -> DataFrame:
    """The smallest verified attempt of each item so far."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return stream.groupBy(item).agg(F.min_by(F.when(good, F.col(value)), F.when(good, F.col(number))).alias(value), F.min(F.when(good, F.col(number))).alias(number))


def json_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream, in the order of the files' times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def append_unseen(stream: DataFrame, log_path: str, key: list[str], order: list[str], schema: str, checkpoint: str, writer: str) -> None:
    """Runs to the end of what is there: of each key that the commit log does not have, the first row is appended.

    Each batch is a transaction of the log, so that one which is run again after a crash adds nothing.
    """
    from sievework.sources.commits import CommitLog

    def write(batch: DataFrame, number: int) -> None:
        CommitLog(batch.sparkSession, log_path).append_once(batch, key, order, schema, (writer, number))

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pending_units(units: DataFrame, kinds: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of a unit and a kind that the log does not hold, without first making those of all units and kinds.

    A unit's done kinds come together as one set (at most as many as there are kinds, a dimension of fixed size), and what
    is missing from the whole set is what is exploded.
    """
    (unit,), (kind,) = units.columns, kinds.columns
    every = kinds.agg(F.array_sort(F.collect_set(kind)).alias("every")).scalar()
    held = done.join(kinds.distinct(), kind, "left_semi").groupBy(unit).agg(F.collect_set(kind).alias("held"))
    left = units.distinct().join(held, unit, "left")
    return left.select(unit, F.explode(F.array_except(every, F.coalesce("held", F.array().cast(held.schema["held"].dataType)))).alias(kind))
