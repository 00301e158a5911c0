"""Gate stacks with reasons, and deduplication among what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reasons(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Adds reasons: the names of all failing tests, in order. A null test does not fail."""
    return rows.withColumn("reasons", F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda r: r.isNotNull()))


def staged_reasons(rows: DataFrame, first: list[tuple[str, Column]], second: list[tuple[str, Column]]) -> DataFrame:
    """Two stages: the second is only asked of rows that pass the first."""
    one = with_reasons(rows, first).withColumnRenamed("reasons", "_one")
    two = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in second]), lambda r: r.isNotNull())
    return one.withColumn("reasons", F.when(F.size("_one") > 0, F.col("_one")).otherwise(two)).drop("_one")


def first_clean(rows: DataFrame, key: list[str], order: list[str], duplicate: str = "duplicate") -> DataFrame:
    """Marks later clean rows of a key as duplicates; only clean rows take part. Expects reasons; adds kept.

    The first of each key comes from a combined aggregate and is joined back, so a key with many rows is never in one
    task. The order must tell a key's rows apart; rows of a null key are one group.
    """
    clean = F.size("reasons") == 0
    # Not a filter on clean: it would be pushed down and have the tests' columns computed once for each use.
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(F.when(clean, F.struct(*order))).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    marked = rows.join(first, same, "left")
    late = clean & (F.struct(*order) != F.col("_first"))
    out = marked.withColumn("kept", clean & ~late).withColumn("reasons", F.when(late, F.array(F.lit(duplicate))).otherwise(F.col("reasons")))
    return out.drop("_first", *[f"_k{i}" for i in range(len(key))])


def dedup_key(mode: str, board: str, level: str, move: str) -> list[str]:
    """The columns of a dedup key: board and move, or board, level and move."""
    return [board, move] if mode == "board_move" else [board, level, move]


def closed_gate(*checks: Column) -> Column:
    """True only if every check is true; null counts as failing."""
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def reason_histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of each reason. Exploded with its empty lists: of explode() Spark infers a filter on their sizes, pushes it below
    the tests and has all of them computed again for it, the texts they share once for each use."""
    each = rows.select(*(by or []), F.explode_outer("reasons").alias("reason")).where(F.col("reason").isNotNull())
    return each.groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))
