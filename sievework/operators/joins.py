"""Joins with the rules that the domain gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*key, "_last.*")


def held_out(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not excluded; null keys stay."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def pending(units: list[DataFrame], done: DataFrame, key: list[str]) -> DataFrame:
    """Every combination of the unit tables that is not done yet; the first may be large, the others are dimensions of fixed size.

    The dimensions' combinations are one array. What a unit has done comes together as a set, at most as large as that
    array, and only what is missing from the array is made rows: no combination is shuffled. A null in a key is a value.
    """
    first, dims = units[0].select(key[0]).distinct(), key[1:]
    if not dims:
        return first.exceptAll(done.select(key[0]).distinct())
    rest = units[1].select(dims[0]).distinct()
    for name, more in zip(dims[1:], units[2:]):
        rest = rest.crossJoin(more.select(name).distinct())
    every = rest.agg(F.array_sort(F.collect_set(F.struct(*dims))).alias("every")).scalar()
    held = done.groupBy(F.col(key[0]).alias("_unit")).agg(F.collect_set(F.struct(*dims)).alias("_held"))
    left = first.join(held, F.col(key[0]).eqNullSafe(F.col("_unit")), "left").withColumn("_every", every)
    return left.select(key[0], F.explode(F.array_except("_every", F.coalesce("_held", F.array().cast(left.schema["_every"].dataType)))).alias("_one")).select(key[0], *[F.col(f"_one.{c}").alias(c) for c in dims])


def complete_items(rows: DataFrame, item: str, member: str, n_members: int) -> DataFrame:
    """Rows of items that have an output of every member (relational division)."""
    whole = rows.groupBy(item).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == n_members).select(item)
    return rows.join(whole, item, "left_semi")


def with_fallback(left: DataFrame, right: DataFrame, key: list[str], value: str, usable: Column, *fallbacks: Column) -> DataFrame:
    """left with value: the right side's if it is there and usable, else the first fallback that is not null."""
    return left.join(right, key, "left").withColumn(value, F.coalesce(F.when(usable, F.col(value)), *fallbacks))


def best_other(rows: DataFrame, item: str, member: str, score: list[str]) -> DataFrame:
    """For each row the best other member of its item: (score..., member down); ties go to the smallest member.

    The two best of an item are read in one pass over it; no self-join of pairs.
    """
    w = Window.partitionBy(item).orderBy(*[F.col(c).desc() for c in score], F.col(member))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(F.col(member).alias("m"), F.struct(*score).alias("s"))
    out = rows.withColumn("_r", F.row_number().over(w)).withColumn("_first", F.first(own).over(whole)).withColumn("_second", F.nth_value(own, 2).over(whole))
    rival = F.when(F.col("_r") == 1, F.col("_second")).otherwise(F.col("_first"))
    return out.withColumn("rival", rival["m"]).withColumn("rival_score", rival["s"]).drop("_r", "_first", "_second")


def ranked_labels(rows: DataFrame, ranking: str, names: str) -> DataFrame:
    """One row for each label of a ranking: its one-based place and the member that the label stands for."""
    out = rows.select("*", F.posexplode(ranking).alias("_p", "label"))
    return out.withColumn("rank", F.col("_p") + 1).withColumn("member", F.element_at(F.col(names), F.col("label"))).drop("_p")


def by_pattern(rows: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Adds family: the first pattern that the text matches. A few patterns as one column, not a join of all pairs."""
    return rows.withColumn("family", F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns]))


def assert_covered(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """`have` if every wanted key is in it; else an error that names how many are missing."""
    missing = wanted.select(key).distinct().join(have.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} of the wanted {key} values are missing")
    return have


def identical_rows(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, differing) for rows that both sides have."""
    r = right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = left.join(r, F.col(key) == F.col("_k"))
    sums = both.agg(*[F.count_if(~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("differing")) for f in fields])))


def compared(old: DataFrame, new: DataFrame, key: str, was: str, now: str, by: Column, name: str) -> DataFrame:
    """Counts by `by` over the full join of stored and new values: same, changed, new, gone. old has o, new has f, both true."""
    joined = old.join(new, key, "full_outer").withColumn("_by", by)
    return joined.groupBy(F.col("_by").alias(name)).agg(F.count_if(F.col(was) == F.col(now)).alias("same"), F.count_if(F.col(was) != F.col(now)).alias("changed"), F.count_if(F.col("o").isNull()).alias("new"), F.count_if(F.col("f").isNull()).alias("gone"))
