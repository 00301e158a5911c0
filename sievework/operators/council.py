"""What a council of judges says of each member, and how a gate's answers came about: all grids in one pass.

A judge's row has an ordered ranking of labels, which label stands for which member, and scores of labels by dimension. Each
label becomes one row (its place, its scores); grouping sets then give every grid at once, from sums and counts that merge.

Defined cases: a label that is not ranked has no rank and is no loss; a missing or null score is no score; a mean of
nothing is null; a row without labels still counts as an item; two labels of one member in one row are two ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def council(rows: DataFrame, dims: list[str], by: list[str] = ()) -> DataFrame:
    """(grid, by..., condition, judge, member, n, mean_rank, win_rate, n_<dim>, mean_<dim>..., items).

    rows: by..., condition, judge, ranking array<string>, names map<label, member>, scores map<label, map<dim, int>>.
    Grids: `members` by condition, `judges` by condition and judge, `pooled` by judge over all conditions, `items` how many
    rows each condition has. Every grid is also by the columns of `by`.
    """
    labels = rows.select(*by, "condition", "judge", "ranking", "scores", F.posexplode_outer(F.map_entries("names")).alias("at", "e"))
    place = F.array_position("ranking", F.col("e.key"))
    own = F.try_element_at("scores", F.col("e.key"))
    flat = labels.select(*by, "condition", "judge", F.col("e.value").alias("member"), F.when(place > 0, place).alias("rank"), *[F.try_element_at(own, F.lit(d)).alias(f"_{d}") for d in dims], F.coalesce(F.col("at") == 0, F.lit(True)).alias("first"))
    sets = {"members": ["condition", "member"], "judges": ["condition", "judge", "member"], "pooled": ["judge", "member"], "items": ["condition"]}
    scores = [c for d in dims for c in (F.count(f"_{d}").alias(f"n_{d}"), F.avg(f"_{d}").alias(f"mean_{d}"))]
    means = [F.count("rank").alias("n"), F.avg("rank").alias("mean_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("win_rate"), *scores]
    kinds = [F.grouping(c).alias(f"_g_{c}") for c in ("condition", "judge", "member")]
    out = flat.groupingSets([[*by, *s] for s in sets.values()], *by, "condition", "judge", "member").agg(*kinds, *means, F.count_if("first").alias("items"))
    key = F.concat("_g_condition", "_g_judge", "_g_member")
    grid = F.when(key == "010", "members").when(key == "000", "judges").when(key == "100", "pooled").otherwise("items")
    counted = F.when(grid == "items", F.col("items"))
    done = out.withColumn("grid", grid).withColumn("items", counted)
    only_members = [F.when(F.col("grid") != "items", F.col(c)).alias(c) for c in ("n", "mean_rank", "win_rate", *[x for d in dims for x in (f"n_{d}", f"mean_{d}")])]
    # A row without labels has no member; it is an item and nothing else.
    return done.where((F.col("grid") == "items") | F.col("member").isNotNull()).select("grid", *by, "condition", "judge", "member", *only_members, "items")


def telemetry(rows: DataFrame, by: str) -> DataFrame:
    """One row for each value of `by`: what its gate did, or what a gate would have said of its first drafts.

    rows: by, ungated, attempts, fallback, clean, formed, sound, fabricated (all nullable). A value with any ungated row is
    measured on its ungated rows alone, by shares of clean, formed, sound and not fabricated; any other by mean attempts (a
    missing number counts as 1), share of fallbacks, clean and formed. Null flags count as false.
    """
    share = lambda flag: F.round(F.count_if(flag) / F.count("*"), 4)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = rows.withColumn("_raw", yes("ungated")).groupBy(by, "_raw").agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("attempts", F.lit(1))), 3).alias("mean_attempts"), share(yes("fallback")).alias("fallback_rate"),
        share(yes("clean")).alias("clean_rate"), share(yes("formed")).alias("formed_rate"), share(yes("sound")).alias("sound_rate"), share(~yes("fabricated")).alias("first_draft_rate"),
    )
    one = kinds.groupBy(by).agg(F.max_by(F.struct(*[c for c in kinds.columns if c != by]), F.col("_raw")).alias("k"))
    raw = F.col("k._raw")
    return one.select(by, (~raw).alias("gated"), "k.n", F.when(~raw, F.col("k.mean_attempts")).alias("mean_attempts"), F.when(~raw, F.col("k.fallback_rate")).alias("fallback_rate"), "k.clean_rate", "k.formed_rate", F.when(raw, F.col("k.sound_rate")).alias("sound_rate"), F.when(raw, F.col("k.first_draft_rate")).alias("first_draft_rate"))


def resolution(rows: DataFrame, by: str) -> DataFrame:
    """How what a first draft made up was resolved, for each value of `by`.

    rows: by, raw_fabricated, gated_fabricated, fallback, attempts. Rates are over all rows; by_model, by_fallback and
    still are counts among the rows whose first draft was fabricated.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rate = lambda c: F.round(F.avg(yes(c).cast("double")), 4)
    raw = yes("raw_fabricated")
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), rate("raw_fabricated").alias("raw_rate"), rate("gated_fabricated").alias("gated_rate"), F.round(rate("gated_fabricated") - rate("raw_fabricated"), 4).alias("delta"),
        rate("fallback").alias("fallback_rate"), F.round(F.avg("attempts"), 4).alias("mean_attempts"),
        F.count_if(raw).alias("fabricated"), F.count_if(raw & ~yes("fallback")).alias("by_model"), F.count_if(raw & yes("fallback")).alias("by_fallback"), F.count_if(raw & yes("gated_fabricated")).alias("still"),
    )
