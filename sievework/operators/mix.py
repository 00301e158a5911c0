"""Assembly of weighted training mixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.buckets import hash_fraction
from sievework.operators.sampling import hash_limit, hash_order, places


@dataclass(frozen=True)
class Recipe:
    """How a mix is made: share of same-move groups to drop, extra copies, and what else goes."""

    name: str
    drop_same: float
    full_boost: int
    discriminating_boost: int
    drop_collapse: bool
    native_only: bool
    valid_fraction: float


# The named mixes.
RECIPES = {
    r.name: r
    for r in (
        Recipe("v5_iter1", 0.5, 1, 1, True, False, 0.05), Recipe("v5_moat", 0.7, 2, 2, True, False, 0.05), Recipe("boost_distinct", 0.85, 3, 2, True, False, 0.05),
        Recipe("boost_tierfit", 0.5, 2, 3, True, False, 0.05), Recipe("boost_principle", 0.5, 1, 1, True, True, 0.05),
    )
}


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(vars(r).values()) for r in RECIPES.values()], "name string, drop_same double, full_boost int, discriminating_boost int, drop_collapse boolean, native_only boolean, valid_fraction double").coalesce(1)


def recipe_for(distinct: Column, fit: Column, principle: Column) -> Column:
    """The recipe that works on the largest gap first; without figures, the moat."""
    known = distinct.isNotNull() | fit.isNotNull() | principle.isNotNull()
    return F.when(~known, "v5_moat").when(distinct < 0.95, "boost_distinct").when(fit < 0.60, "boost_tierfit").when(principle < 1.5, "boost_principle").otherwise("boost_distinct")


def next_recipe(metrics: DataFrame) -> DataFrame:
    """(recipe) for rows of (distinct, fit, principle)."""
    return metrics.select(recipe_for(F.col("distinct"), F.col("fit"), F.col("principle")).alias("recipe"))


def replicated(rows: DataFrame, copies: Column) -> DataFrame:
    """Each row `copies` times, with copy from 1; rows with 0 go."""
    return rows.withColumn("_n", copies.cast("int")).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def mixed(rows: DataFrame, recipe: Recipe, group: str, klass: str, level: str, discriminating: str, native: str, seed: int = 0) -> DataFrame:
    """rows of the mix with is_valid and copy. Groups never straddle; boosts add up; valid rows are not copied or dropped by class."""
    kept = rows
    if recipe.drop_collapse:
        kept = kept.where(~((F.col(klass) == "collapse_BA") & (F.col(level) == "intermediate")))
    if recipe.native_only:
        kept = kept.where(F.col(native))
    limit, _ = hash_limit(rows.select(group).distinct(), group, None, recipe.valid_fraction, seed)
    joined = kept.withColumn("is_valid", hash_order(group, seed) <= F.lit(limit))
    dropped = ~F.col("is_valid") & (F.col(klass) == "all_same") & (hash_fraction(F.coalesce(F.col(group).cast("string"), F.lit(""))) < recipe.drop_same)
    copies = 1 + F.when(F.col(klass) == "full", recipe.full_boost).otherwise(0) + F.when(F.col(discriminating), recipe.discriminating_boost).otherwise(0)
    return replicated(joined.where(~dropped), F.when(F.col("is_valid"), 1).otherwise(copies))


def cyclic_oversample(rows: DataFrame, order: str, factor: float, n: int) -> DataFrame:
    """rows, and round((factor - 1) * n) more taken in order over and over; n is how many rows there are."""
    extra = round((factor - 1) * n)
    ranked_ = places(rows, [], order, [], "_p") if extra % n else rows.withColumn("_p", F.lit(1))
    copies = 1 + extra // n + (F.col("_p") <= extra % n).cast("int")
    return replicated(ranked_, copies).drop("_p")


def weighted_expand(rows: DataFrame, key: str, weight: Column, seed: int = 0) -> DataFrame:
    """floor(weight) copies, and one more with the chance of the rest, decided by a hash."""
    chance = hash_fraction(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return replicated(rows, F.floor(weight) + (chance < weight - F.floor(weight)).cast("int"))


def capped_class(groups: DataFrame, key: str, is_capped: Column, share: float, seed: int = 0) -> DataFrame:
    """groups with at most int(share * others) of the capped class, whole groups, chosen by hash."""
    marked = groups.withColumn("_c", is_capped)
    others = marked.where("not _c").count()
    limit, _ = hash_limit(marked.where("_c").select(key).distinct(), key, int(share * others), seed=seed)
    return marked.where(~F.col("_c") | (hash_order(key, seed) <= F.lit(limit))).drop("_c")


def contrastive_plan(picks: DataFrame, item: str, level: str, pick: str) -> DataFrame:
    """Items with two or more distinct picks give all their levels; others only their first level."""
    kinds = picks.groupBy(item).agg(F.countDistinct(pick).alias("_k"), F.min(level).alias("_first"))
    return picks.join(kinds, item).where((F.col("_k") >= 2) | (F.col(level) == F.col("_first"))).withColumn("contrastive", F.col("_k") >= 2).drop("_k", "_first")


def best_of(rows: DataFrame, item: list[str], survives: str, score: str, order: str, gap: float = 1.5) -> DataFrame:
    """One row of each item with survivors: the best by (score, order); `how` is sole, score, or judge if the two best are within the gap.

    Items without survivors give their best row with how = salvage.
    """
    w = Window.partitionBy(*item).orderBy(F.col(survives).desc(), F.col(score).desc(), order)
    out = rows.withColumn("_p", F.row_number().over(w)).withColumn("_next", F.lead(F.when(F.col(survives), F.col(score))).over(w)).where("_p = 1")
    how = F.when(~F.col(survives), "salvage").when(F.col("_next").isNull(), "sole").when(F.col(score) - F.col("_next") <= gap, "judge").otherwise("score")
    return out.withColumn("how", how).drop("_p", "_next")


def preference_pairs(rows: DataFrame, item: str, level: str, pick: str, text: str) -> DataFrame:
    """Pairs of a level's target and the same target with another level's pick put in its place, where the picks differ.

    Targets that do not hold the pick as a token, or that already hold the other, give no pair.
    """
    from sievework.functions.text import swapped_token

    other = rows.select(F.col(item).alias("_i"), F.col(level).alias("_l"), F.col(pick).alias("rejected_pick"))
    both = rows.join(other, (F.col(item) == F.col("_i")) & (F.col(level) != F.col("_l")) & (F.col(pick) != F.col("rejected_pick")))
    swapped = both.withColumn("rejected", swapped_token(F.col(text), F.col(pick), F.col("rejected_pick")))
    return swapped.where((F.col("rejected") != F.col(text)) & ~F.contains(F.col(text), F.col("rejected_pick"))).select(item, level, F.col(text).alias("chosen"), "rejected", pick, "rejected_pick")


def balanced_pairs(pairs: DataFrame, level: str, cell: list[str], weight: str, key: str, target: int) -> DataFrame:
    """target / 3 pairs of each level, round robin over the cells, heaviest first."""
    inner = pairs.withColumn("_p", F.row_number().over(Window.partitionBy(level, *cell).orderBy(F.col(weight).desc(), key)))
    near = inner.where(F.col("_p") <= target // 3)  # no cell gives more, so this bounds what a level's window sees
    outer = near.withColumn("_q", F.row_number().over(Window.partitionBy(level).orderBy("_p", *cell)))
    return outer.where(F.col("_q") <= target // 3).drop("_p", "_q")


def collapsed_boards(rows: DataFrame, key: str, order: str, synthetic: str, fields: list[str]) -> DataFrame:
    """One row of each key: the first; the fields come from the first real row if the first is synthetic and a real one follows."""
    rest = [c for c in rows.columns if c not in (key, *fields)]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_f")
    own = F.min_by(F.struct(*fields), F.struct(F.col(synthetic), F.col(order))).alias("_o")
    return rows.groupBy(key).agg(first, own).select(key, "_f.*", "_o.*")
