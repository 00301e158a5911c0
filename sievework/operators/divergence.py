"""How a model's picks differ between levels, from the best move and from the human one.

picks has one row for each (model, pos, level): pick, best, canonical, level_pick, human (the level's likeliest move), rank
and best_rank (places of the pick and of the best move among the human candidates, 0 first), order_rank (place in the
engine's order), policy and best_policy (shares of players, null where unknown), mode (how the pick was found), genuine,
discriminating, violations, phase, severity. A position counts across levels only if all three are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.buckets import LEVELS


def _each(name: str, level: str) -> Column:
    return F.col(f"at_{level}.{name}")


def by_position(picks: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each (model, pos): at_{level}, a struct of the fields, null without a row; full: all levels are there."""
    own = F.struct(*fields)
    wide = picks.groupBy("model", "pos").agg(*[F.any_value(F.when(F.col("level") == x, own), True).alias(f"at_{x}") for x in LEVELS])
    full = F.lit(True)
    for x in LEVELS:
        full = full & F.col(f"at_{x}").isNotNull()
    return wide.withColumn("full", full)


def _kinds(with_null: bool) -> Column:
    """How many different picks the levels have; a missing pick is a kind of its own or none."""
    every = F.array(*[_each("pick", x) for x in LEVELS])
    return F.size(F.array_distinct(every if with_null else F.filter(every, lambda p: p.isNotNull())))


def _all(test) -> Column:
    out = F.lit(True)
    for x in LEVELS:
        out = out & F.coalesce(test(x), F.lit(False))
    return out


def level_metrics(picks: DataFrame) -> DataFrame:
    """By model: fit by level and its plain mean over levels; over full positions the share whose levels differ, whose every
    pick is the best move, and the direction (beginner's pick easier to find than advanced's; equal counts half); mirror by
    level, share of genuine beginner picks, and fit to the level's own move where the level discriminates."""
    wide = by_position(picks, ["pick", "best", "canonical", "level_pick", "rank", "genuine", "discriminating"])
    there = lambda x: F.col(f"at_{x}").isNotNull()
    rate = lambda test, of: F.avg(F.when(of, F.coalesce(test, F.lit(False)).cast("double")))
    b, a = _each("rank", "beginner"), _each("rank", "advanced")
    ranked = F.col("full") & b.isNotNull() & a.isNotNull()
    fits = [rate(_each("pick", x) == _each("canonical", x), there(x)).alias(f"fit_{x}") for x in LEVELS]
    mirrors = [rate(_each("pick", x).eqNullSafe(_each("best", x)), there(x)).alias(f"mirror_{x}") for x in LEVELS]
    own = [rate(_each("pick", x) == _each("level_pick", x), there(x) & _each("discriminating", x)).alias(f"own_{x}") for x in LEVELS]
    out = wide.groupBy("model").agg(
        F.count("*").alias("n_pos"), F.count_if("full").alias("n_full"), *fits, *mirrors, *own,
        rate(_kinds(False) > 1, F.col("full")).alias("differ"), rate(_all(lambda x: _each("pick", x).eqNullSafe(_each("best", x))), F.col("full")).alias("mirror_all"),
        F.avg(F.when(ranked, F.when(b < a, 1.0).when(b == a, 0.5).otherwise(0.0))).alias("direction"), rate(_each("genuine", "beginner"), there("beginner")).alias("genuine"),
    )
    known = F.filter(F.array(*[f"fit_{x}" for x in LEVELS]), lambda v: v.isNotNull())
    return out.withColumn("fit_mean", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)))


def gap_metrics(picks: DataFrame) -> DataFrame:
    """By model, over full positions: spread of distinct picks, mirrors, ranks; how much easier to find than the best move
    the beginner's pick is (best_rank less rank), also where the best move is not the easiest; policy gap; false outputs."""
    wide = by_position(picks, ["pick", "best", "human", "rank", "best_rank", "order_rank", "policy", "best_policy", "genuine", "violations"]).where("full")
    kinds, genuine = _kinds(True), _all(lambda x: _each("genuine", x))
    x = "beginner"
    gap = _each("best_rank", x) - _each("rank", x)
    open_ = gap.isNotNull() & (_each("best_rank", x) > 0)
    false_ = [F.coalesce(_each("violations", y), F.lit(0)) for y in LEVELS]
    per = []
    for y in LEVELS:
        per += [F.count_if(_each("pick", y) == _each("best", y)).alias(f"best_{y}"), F.count_if(_each("pick", y) == _each("human", y)).alias(f"human_{y}"), F.avg(_each("rank", y)).alias(f"rank_{y}"), F.avg(_each("order_rank", y)).alias(f"order_{y}"), F.count_if(_each("rank", y) == 0).alias(f"easiest_{y}")]
    return wide.groupBy("model").agg(
        F.count("*").alias("n"), *[F.count_if(kinds == k).alias(f"kinds_{k}") for k in (1, 2, 3)], F.count_if(kinds > 1).alias("differ"), F.count_if(genuine).alias("genuine"), F.count_if(genuine & (kinds > 1)).alias("genuine_differ"),
        *per, F.count_if(_all(lambda y: _each("pick", y) == _each("best", y))).alias("mirror_all"),
        F.count(gap).alias("gaps"), F.avg(gap).alias("gap_mean"), F.count_if(gap > 0).alias("gap_above"), F.count_if(gap == 0).alias("gap_zero"), F.count_if(gap < 0).alias("gap_below"),
        F.avg(F.when(gap.isNotNull(), _each("policy", x) - _each("best_policy", x))).alias("policy_gap"),
        F.count_if(open_).alias("open"), F.avg(F.when(open_, gap)).alias("open_gap"), F.count_if(open_ & (_each("rank", x) == 0)).alias("open_easiest"), F.count_if(open_ & (_each("pick", x) == _each("best", x))).alias("open_mirror"),
        F.sum(sum(F.when(v > 0, 1).otherwise(0) for v in false_)).alias("n_false"), F.sum(sum(false_)).alias("violations"),
    )


def value_table(picks: DataFrame) -> DataFrame:
    """By model: genuine picks that are the best move, the human one, both or neither."""
    best, human = F.coalesce(F.col("pick") == F.col("best"), F.lit(False)), F.coalesce(F.col("pick") == F.col("human"), F.lit(False))
    kind = F.when(best & human, "both").when(best, "best_only").when(human, "human_only").otherwise("neither")
    return picks.where("genuine").groupBy("model", kind.alias("kind")).agg(F.count("*").alias("n"))


def direction_table(picks: DataFrame) -> DataFrame:
    """By model and level, over full positions of genuine picks that differ: picks that are human, that are best, mean place."""
    wide = by_position(picks, ["pick", "best", "human", "order_rank", "genuine"]).where("full")
    rows = wide.where(_all(lambda x: _each("genuine", x)) & (_kinds(False) > 1))
    each = rows.select("model", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"at_{x}").alias("p")) for x in LEVELS])).alias("x"))
    return each.groupBy("model", F.col("x.level").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("x.p.pick") == F.col("x.p.human")).alias("human"), F.count_if(F.col("x.p.pick") == F.col("x.p.best")).alias("best"), F.avg("x.p.order_rank").alias("mean_place"))


def difference_by(picks: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, differ, n): by each axis, full positions whose levels differ; several models count apart."""
    wide = by_position(picks, ["pick", *axes]).where("full").withColumn("differ", (_kinds(False) > 1).cast("long"))
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), _each(a, LEVELS[0]).cast("string").alias("value")) for a in axes])
    return wide.select("differ", F.explode(pairs).alias("x")).groupBy("x.axis", "x.value").agg(F.sum("differ").alias("differ"), F.count("*").alias("n"))


def modal_picks(rows: DataFrame, by: list[str], pick: str, order: str) -> DataFrame:
    """(by, modal, n_kinds, n): the most frequent pick of each group; of equals the one that comes first by order."""
    counted = rows.groupBy(*by, pick).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(pick, F.struct("n", -F.col("first"))).alias("modal"), F.count("*").alias("n_kinds"), F.sum("n").alias("n"))


def all_same(rows: DataFrame, board: str, level: str, pick: str, order: str, pool_size: str) -> DataFrame:
    """(kind, n) over boards that have all levels: picks of all levels the same and forced (a pool of at most one), the same
    though they might differ, only the outer levels the same, or different."""
    modal = modal_picks(rows, [board, level], pick, order)
    least = rows.groupBy(board).agg(F.min(pool_size).alias("least"))
    at = {x: F.max(F.when(F.col(level) == x, F.col("modal"))).alias(x) for x in LEVELS}
    wide = modal.groupBy(board).agg(*at.values(), F.countDistinct(level).alias("levels")).where(F.col("levels") == len(LEVELS)).join(least, board)
    b, i, a = (F.col(x) for x in LEVELS)
    kind = F.when((b == i) & (i == a), F.when(F.col("least") <= 1, "same_forced").otherwise("same_missed")).when(b == a, "outer_same").otherwise("different")
    return wide.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def dimension_means(scores: DataFrame, by: str, dims: tuple[str, ...]) -> DataFrame:
    """By member: the mean of each dimension to three places (null where it was never scored), their sum, and the largest
    number of scores of a dimension. scores has (by, dim, score)."""
    one = lambda d: F.col("dim") == d
    out = scores.groupBy(by).agg(*[F.round(F.avg(F.when(one(d), F.col("score"))), 3).alias(d) for d in dims], *[F.count(F.when(one(d), F.col("score"))).alias(f"n_{d}") for d in dims])
    known = F.filter(F.array(*dims), lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), 3))
    return out.select(by, *dims, total.alias("total"), F.greatest(*[f"n_{d}" for d in dims]).alias("n"))


def field_ranks(rankings: DataFrame, ranking: str, condition: Column | None = None) -> DataFrame:
    """By member of the ranked arrays, in rows that meet the condition: mean rank, mean rank scaled by its own row's field
    (0 first, 1 last), share of firsts in percent, and rows."""
    rows = rankings if condition is None else rankings.where(condition)
    each = rows.select(F.size(ranking).alias("field"), F.posexplode(ranking).alias("place", "member"))
    scaled = F.when(F.col("field") > 1, F.col("place") / (F.col("field") - 1)).otherwise(0.0)
    return each.groupBy("member").agg(F.avg(F.col("place") + 1).alias("mean_rank"), F.avg(scaled).alias("scaled_rank"), (100 * F.avg((F.col("place") == 0).cast("double"))).alias("win"), F.count("*").alias("n"))


def coverage_tallies(rows: DataFrame, split: str, item: str, flags: list[str]) -> DataFrame:
    """By split and over all: items, how many have each flag, and whether all have the last one. Items are unique."""
    sums = [F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags], F.coalesce(F.bool_and(F.coalesce(flags[-1], F.lit(False))), F.lit(False)).alias("complete")]
    return rows.groupingSets([[split], []], split).agg(*sums).select(F.coalesce(split, F.lit("ALL")).alias(split), "n", *flags, "complete")


def eligible(best_cp: Column, is_mate: Column, n_sound: Column, n_discriminating: Column, decided: int) -> Column:
    """Not decided already, at least two sound moves, and a level that discriminates."""
    trivial = F.coalesce(is_mate, F.lit(False)) | F.coalesce(F.abs(best_cp) >= decided, F.lit(False))
    return ~trivial & (n_sound >= 2) & (n_discriminating >= 1)


def drained_round_robin(rows: DataFrame, stratum: str, bucket: str, order: str, preferred: list, most: int) -> DataFrame:
    """Adds turn: in each stratum rows are taken bucket by bucket in turn, preferred buckets first, each in order, until
    `most` are taken; a bucket leaves the circle when it is empty, which moves the next turn on.

    Only the buckets' sizes decide the turns, so those (a few numbers for each stratum) are played through on the driver.
    """
    place = F.row_number().over(Window.partitionBy(stratum, bucket).orderBy(order))
    near = rows.withColumn("_place", place).where(F.col("_place") <= most)
    sizes: dict = {}
    for r in near.groupBy(stratum, bucket).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy("first").collect():
        sizes.setdefault(r[0], {})[r[1]] = r["n"]
    plan = []
    for name, left in sizes.items():
        circle = [b for b in preferred if b in left] + [b for b in left if b not in preferred]
        used, turn = dict.fromkeys(left, 0), 0
        while circle and turn < most:
            own = circle[turn % len(circle)]
            used[own] += 1
            turn += 1
            plan.append((name, own, used[own], turn))
            if used[own] == left[own]:
                circle.remove(own)
    kinds = dict(rows.dtypes)
    turns = rows.sparkSession.createDataFrame(plan, f"_stratum {kinds[stratum]}, _bucket {kinds[bucket]}, _at int, turn int").coalesce(1)
    same = F.col(stratum).eqNullSafe(F.col("_stratum")) & F.col(bucket).eqNullSafe(F.col("_bucket")) & (F.col("_place") == F.col("_at"))
    return near.join(F.broadcast(turns), same).drop("_place", "_stratum", "_bucket", "_at")
