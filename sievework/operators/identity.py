"""Whether two tables hold the same rows, without moving them: digests that do not depend on order, narrowed to what differs.

Each row is hashed over all compared fields, nulls told from values. A table's digest is, for each of a fixed number of
ranges of the key's hash, how many rows there are and the sum of their hashes: sums merge, so a task sends as many numbers
as there are ranges, and a repeated row counts. Only the rows of ranges that differ are then compared key by key.

Defined cases: null is equal to null, in keys too; a row that is there twice on one side and once on the other is reported;
two empty tables are the same; columns that are not named are not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 4096


def _hashed(rows: DataFrame, key: list[str], fields: list[str], ranges: int) -> DataFrame:
    of = lambda names, *more: F.xxhash64(*more, *[x for c in names for x in (F.col(c), F.col(c).isNull())])
    wide = lambda h: h.cast("decimal(20,0)")
    every = [*key, *fields]
    return rows.select(*key, F.pmod(of(key), F.lit(ranges)).cast("int").alias("range"), wide(of(every)).alias("h1"), wide(of(every, F.lit(1))).alias("h2"))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")]


def digest(rows: DataFrame, key: list[str], fields: list[str], ranges: int = RANGES) -> DataFrame:
    """(range, n, h1, h2): the digest of a table."""
    return _hashed(rows, key, fields, ranges).groupBy("range").agg(*_sums())


def _unlike(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full join of two digests by `on`, where they differ: a (left) and b (right) are structs, null where there is nothing."""
    pack = lambda rows, name: rows.select(*[F.col(c).alias(f"{name}_{c}") for c in on], F.struct("n", "h1", "h2").alias(name))
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = pack(left, "a").join(pack(right, "b"), same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    # A key of nulls on one side is told from a side that has nothing by the struct beside it.
    return both.select(*[F.when(F.col("a").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in on], "a", "b")


def differing_ranges(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], ranges: int = RANGES) -> DataFrame:
    """(range) where the tables differ: at most `ranges` rows."""
    return _unlike(digest(left, key, fields, ranges), digest(right, key, fields, ranges), ["range"]).select("range")


def differing_keys(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], ranges: int = RANGES) -> DataFrame:
    """(key..., kind, left_n, right_n) of each key whose rows are not the same on both sides.

    kind: missing (only left has it), extra (only right), repeated (as many kinds of rows, other counts of them), changed.
    """
    # The ranges are at most `ranges` whole numbers, so they may be sent to every task.
    narrow = F.broadcast(differing_ranges(left, right, key, fields, ranges))
    per_row = lambda rows: _hashed(rows, key, fields, ranges).join(narrow, "range", "left_semi").groupBy(*key, "h1", "h2").agg(F.count("*").alias("m"))
    exact = lambda c: F.sum((F.col(c) * F.col("m")).cast("decimal(38,0)"))
    kinds = F.sum("h1").alias("k1"), F.sum("h2").alias("k2")
    sides = []
    for rows in (left, right):
        sides.append(per_row(rows).groupBy(*key).agg(F.sum("m").alias("n"), exact("h1").alias("h1"), exact("h2").alias("h2"), *kinds))
    pack = lambda rows, name: rows.select(*[F.col(c).alias(f"{name}_{c}") for c in key], F.struct("n", "h1", "h2", "k1", "k2").alias(name))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = pack(sides[0], "a").join(pack(sides[1], "b"), same, "full_outer").where(~F.struct("a.n", "a.h1", "a.h2").eqNullSafe(F.struct("b.n", "b.h1", "b.h2")))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when((F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")), "repeated").otherwise("changed")
    own = [F.when(F.col("a").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in key]
    return both.select(*own, kind.alias("kind"), F.coalesce("a.n", F.lit(0)).alias("left_n"), F.coalesce("b.n", F.lit(0)).alias("right_n"))


def assert_same(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> None:
    """Raises if the tables differ, with how many ranges do."""
    if n := differing_ranges(left, right, key, fields).count():
        raise ValueError(f"the tables differ in {n} of {RANGES} ranges of {key}")
