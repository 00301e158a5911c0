"""Choosing one item of a group by deterministic rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sievework.functions import buckets as B

#: Share of the policy in the blended score, and the policy that the second rule asks for.
BLEND = {"beginner": 1.0, "intermediate": 0.5, "advanced": 0.0}
GATE = {"beginner": 0.10, "intermediate": 0.05, "advanced": 0.0}


def zero_filled(counts: DataFrame, key: str, every: Iterable[str], value: str) -> DataFrame:
    """counts with a row for each of `every`; what is missing counts 0."""
    frame = counts.sparkSession.createDataFrame([(x,) for x in every], f"{key} string").coalesce(1)
    return frame.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def normalised(value: Column, w: WindowSpec) -> Column:
    """(v - min) / (max - min) in the group; 1 where the group is flat."""
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def pool_rank(rows: DataFrame, group: str, policy: str, order: str) -> DataFrame:
    """Adds rank: zero-based, by policy down, then order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(policy).desc(), order)) - 1)


def blended_pick(rows: DataFrame, group: str, cp: str, policy: str, order: str, weight: float) -> DataFrame:
    """The row of each group with the best (blend of normalised cp and policy, cp, order)."""
    w = Window.partitionBy(group)
    score = F.round((1 - weight) * normalised(F.col(cp), w) + weight * normalised(F.coalesce(F.col(policy), F.lit(0.0)), w), 4)
    scored = rows.withColumn("score", score)
    best = scored.groupBy(group).agg(F.max_by(F.struct(*[c for c in scored.columns if c != group]), F.struct("score", F.col(cp), -F.col(order))).alias("best"))
    return best.select(group, "best.*")


def sound_pool(rows: DataFrame, group: str, cp: str, tolerance: int = B.SOUND_TOLERANCE) -> DataFrame:
    """Rows whose loss against the best of the group is at most min(tolerance, blunder - 1)."""
    limit = min(tolerance, B.BLUNDER - 1)
    return rows.withColumn("_best", F.max(cp).over(Window.partitionBy(group))).where(F.col("_best") - F.col(cp) <= limit).drop("_best")


def first_failing(rows: DataFrame, group: str, cp: str, order: str, tests: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first test that holds, null if none; the best of the group is never rejected."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(cp).desc(), order))
    reason = F.coalesce(*[F.when(test, name) for name, test in tests])
    return rows.withColumn("reason", F.when(place == 1, F.lit(None).cast("string")).otherwise(reason))


def triads(pool: DataFrame) -> DataFrame:
    """Picks of the three levels of each group by the second rule, in one aggregation.

    Advanced takes the best; the others take, among rows whose policy passes their gate, the best of (robustness, policy,
    cp, order), and the best of all if none passes. If beginner and advanced agree, intermediate follows them.
    """
    best = F.max("cp").over(Window.partitionBy("gid"))
    rows = pool.withColumn("best", best)
    robust = F.when(F.coalesce("agree", F.lit(True)), 2).otherwise(0) + (F.col("best") - F.col("cp") < 40).cast("int") - F.floor(F.greatest(F.lit(0), F.col("best") - F.col("cp")) / 40)
    rows = rows.withColumn("robust", robust)

    def pick(policy: str, level: str) -> Column:
        passes = F.coalesce(policy, F.lit(0.0)) >= GATE[level]
        return F.max_by(F.when(passes, F.col("idx")), F.when(passes, F.struct("robust", policy, "cp", (-F.col("idx")).alias("o"))))

    out = rows.groupBy("gid").agg(F.max_by("idx", F.struct("cp", (-F.col("idx")).alias("o"))).alias("a"), pick("p_b", "beginner").alias("b0"), pick("p_i", "intermediate").alias("i0"))
    out = out.select("gid", F.coalesce("b0", "a").alias("b"), F.coalesce("i0", "a").alias("i0"), "a", F.col("b0").isNull().alias("fallback"))
    out = out.withColumn("i", F.when((F.col("b") == F.col("a")) & (F.col("i0") != F.col("b")), F.col("b")).otherwise(F.col("i0"))).drop("i0")
    return out.withColumn("discriminating", F.col("b") != F.col("a")).withColumn("pattern", B.triad_pattern(F.col("b"), F.col("i"), F.col("a")))


def confident(picked: DataFrame, pool: DataFrame, least: float = 0.10, lead: float = 0.05) -> DataFrame:
    """Adds high_confidence: levels differ, the beginner's pick is findable, and it leads the best by a margin."""
    tops = picked.join(pool.select("gid", "idx", "p_b"), "gid").groupBy(*[picked[c] for c in picked.columns]).agg(
        F.max(F.when(F.col("idx") == F.col("b"), F.col("p_b"))).alias("pb"), F.max(F.when(F.col("idx") == F.col("a"), F.col("p_b"))).alias("pa"))
    sure = F.col("discriminating") & (F.col("pb") >= least) & (F.round(F.col("pb") - F.col("pa"), 6) >= lead)
    return tops.withColumn("high_confidence", sure)


def scenarios(wide: DataFrame, key: str, value: str, levels: tuple[str, ...] = B.LEVELS) -> DataFrame:
    """One row for each level of each key, with the level's own column as `value` and the id key#level."""
    pairs = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias(value)) for x in levels])
    return wide.select(key, F.inline(pairs)).withColumn("scenario", F.concat(F.col(key).cast("string"), F.lit("#"), "level"))
