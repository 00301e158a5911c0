"""Chat rows in long form (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_pair(turns: DataFrame) -> DataFrame:
    """The first user and the first assistant message of each conversation; those that lack either go."""
    of = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    there = lambda role: F.bool_or(F.col("role") == role)
    out = turns.groupBy("conv_id").agg(of("user").alias("first_user"), of("assistant").alias("first_assistant"), there("user").alias("_u"), there("assistant").alias("_a"))
    return out.where("_u and _a").drop("_u", "_a")
