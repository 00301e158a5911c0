"""Resumable, append-only processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log at the path; an empty frame where there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def still_to_do(units: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return units.join(done.select(*key).distinct(), key, "left_anti")


def append_new(source: DataFrame, target: DataFrame, key: list[str], keep: Column, order: str) -> DataFrame:
    """Rows of the source that match, once per key, whose key the target does not have."""
    fresh = source.where(keep).withColumn("_one", F.struct(*source.columns))
    once = fresh.groupBy(*key).agg(F.min_by("_one", F.col(order)).alias("_one")).select("_one.*")
    return still_to_do(once, target, key)


def first_verified(attempts: DataFrame, item: str, number: str, ok: str, value: str, budget: int, fallback: Column) -> DataFrame:
    """(item, value, pick, attempts, fell_back): the first attempt within the budget that is verified, else the fallback.

    A null verdict counts as failed. pick is the first attempt's, whatever becomes of its text.
    """
    inside = attempts.where(F.col(number) <= budget)
    good = F.coalesce(F.col(ok), F.lit(False))
    out = inside.groupBy(item).agg(F.min(F.when(good, F.col(number))).alias("_n"), F.min_by(F.when(good, F.col(value)), F.when(good, F.col(number))).alias("_v"), F.min_by(F.col(value), F.col(number)).alias("pick"), F.max(number).alias("_m"))
    return out.select(item, F.coalesce("_v", fallback).alias(value), "pick", F.coalesce("_n", "_m").alias("attempts"), F.col("_n").isNull().alias("fell_back"))
