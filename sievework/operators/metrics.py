"""Aggregations over scored outputs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.buckets import wilson
from sievework.operators.sampling import places


def rate(flag: str | Column) -> Column:
    """Share of true among the rows where it is not null; null for none."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(c.cast("double"))


def dense(rates: DataFrame, *frames: DataFrame) -> DataFrame:
    """rates on the grid of the (small) frames; cells without rows are null, cells off the grid go."""
    grid = frames[0]
    for f in frames[1:]:
        grid = grid.crossJoin(f)
    return grid.coalesce(1).join(rates, grid.columns, "left")


def with_all(rows: DataFrame, by: str, aggregates: list[Column], name: str = "ALL") -> DataFrame:
    """One row for each value of `by` and one for all together: one pass by grouping sets."""
    marked = rows.withColumn(by, F.col(by).cast("string"))
    out = marked.groupingSets([[by], []], by).agg(F.grouping(by).alias("_g"), *aggregates)
    return out.withColumn(by, F.when(F.col("_g") == 1, name).otherwise(F.col(by))).drop("_g")


def macro(rows: DataFrame, by: list[str], level: str, flag: str) -> DataFrame:
    """Unweighted mean over levels of the level's rate, and the plain rate."""
    per = rows.groupBy(*by, level).agg(F.sum(F.col(flag).cast("long")).alias("_k"), F.count(flag).alias("_n"))
    return per.groupBy(*by).agg(F.avg(F.col("_k") / F.col("_n")).alias("macro"), (F.sum("_k") / F.sum("_n")).alias("micro"))


def mean_of_rounded(rows: DataFrame, item: list[str], by: str, value: str, places: int = 2) -> DataFrame:
    """Mean over items of the item's mean rounded."""
    per = rows.groupBy(*item, by).agg(F.round(F.avg(value), places).alias("_m"))
    return per.groupBy(by).agg(F.avg("_m").alias("mean"))


def distinct_rate(rows: DataFrame, item: str, level: str, pick: str, truth: str) -> DataFrame:
    """Of the items whose truth differs between the outer levels, the share whose picks do; unanswered ones count as misses."""
    wide = rows.groupBy(item).agg(*[F.max(F.when(F.col(level) == x, F.col(c))).alias(f"{c}_{n}") for c in (pick, truth) for x, n in (("beginner", "b"), ("advanced", "a"))])
    chance = wide.where(F.col(f"{truth}_b") != F.col(f"{truth}_a"))
    hit = F.coalesce(F.col(f"{pick}_b") != F.col(f"{pick}_a"), F.lit(False))
    return chance.agg(F.count("*").alias("opportunities"), F.count_if(hit).alias("distinct_picks"))


def coherence(rows: DataFrame, item: str, level: str, pick: str) -> DataFrame:
    """Counts of items with all three levels that zigzag (b = a, other i), are inverted (b above a), or flat."""
    wide = rows.groupBy(item).agg(*[F.max(F.when(F.col(level) == x, F.col(pick))).alias(n) for x, n in (("beginner", "b"), ("intermediate", "i"), ("advanced", "a"))])
    whole = wide.where("b is not null and i is not null and a is not null")
    zigzag, inverted, flat = (F.col("b") == F.col("a")) & (F.col("i") != F.col("b")), F.col("b") < F.col("a"), (F.col("b") == F.col("i")) & (F.col("i") == F.col("a"))
    return whole.agg(F.count("*").alias("items"), F.count_if(zigzag).alias("zigzag"), F.count_if(inverted).alias("inverted"), F.count_if(flat).alias("flat"), F.count_if(zigzag | inverted | flat).alias("violations"))


def average_tie_rank(rows: DataFrame, group: list[str], grade: str) -> DataFrame:
    """Adds rank, by grade down, ties share their mean rank; and top, true for all that tie for the first."""
    w = Window.partitionBy(*group)
    place = F.rank().over(w.orderBy(F.col(grade).desc()))
    ties = F.count("*").over(Window.partitionBy(*group, grade))
    return rows.withColumn("rank", place + (ties - 1) / 2.0).withColumn("top", place == 1)


def self_preference(ranks: DataFrame, judge: str, member: str, rank: str) -> DataFrame:
    """For each member with a judge of its own: others' mean rank less its own judge's, and the same with the sign turned."""
    own = F.col(judge) == F.col(member)
    out = ranks.groupBy(member).agg(F.avg(F.when(own, F.col(rank))).alias("_own"), F.avg(F.when(~own, F.col(rank))).alias("_others")).where(F.col("_own").isNotNull())
    return out.select(member, (F.col("_others") - F.col("_own")).alias("others_minus_own"), (F.col("_own") - F.col("_others")).alias("own_minus_others"))


def corrected_ranks(ranks: DataFrame, judge: str, member: str, rank: str, field: int) -> DataFrame:
    """Mean rank with and without one's own judge, share of first places, and the corrected rank in [0, 1]."""
    others = F.when(F.col(judge) != F.col(member), F.col(rank))
    out = ranks.groupBy(member).agg(F.avg(rank).alias("raw"), F.avg(others).alias("corrected"), F.avg((F.col(rank) == 1).cast("double")).alias("first_share"))
    return out.withColumn("normal", (F.col("corrected") - 1) / (field - 1))


def bootstrap(items: DataFrame, key: str, value: str, n_boot: int, n_items: int, seed: int, index: str = "last") -> DataFrame:
    """(low, high): a 95 % interval of the mean over items drawn with replacement.

    Items carry a dense number in `key`. Draw b, i takes the item that a hash of (seed, b, i) names, so any engine can
    repeat it. The means of draws, n_boot numbers, are the only thing gathered. `index` is how a percentile is placed:
    'last' int(q * (B - 1)), 'count' int(q * B).
    """
    spark = items.sparkSession
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    draws = spark.range(n_boot).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))).alias("i")).withColumn(key, digest % n_items)
    means = draws.join(items.select(key, value), key).groupBy("b").agg(F.avg(value).alias("m"))
    sorted_ = means.agg(F.array_sort(F.collect_list("m")).alias("all"))
    at = lambda q: int(q * (n_boot - 1)) if index == "last" else min(n_boot - 1, int(q * n_boot))
    return sorted_.select(F.get("all", F.lit(at(0.025))).alias("low"), F.get("all", F.lit(at(0.975))).alias("high"))


def _poisson_cuts() -> list[int]:
    """Where a uniform 32-bit number passes from k to k + 1 of the Poisson law of mean 1."""
    return [math.floor(4294967296 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(13)]


def poisson_bootstrap(rows: DataFrame, item: str, value: str, n_boot: int, seed: int, index: str = "last") -> DataFrame:
    """(low, high): a 95 % interval of the mean over clusters of rows, in one pass.

    In draw b each item weighs what the Poisson law of mean 1 gives for a hash of (seed, b, item), as if it had been drawn
    with replacement from very many; so a row needs no other row, a task keeps n_boot sums and weights, and these are all
    that is moved. A digest holds the numbers of eight draws. Null values count as no rows; null items are one item; without
    rows both ends are null. `index` as in bootstrap().
    """
    cuts = np.array(_poisson_cuts())

    def weights(items: list[str]) -> np.ndarray:
        blocks = -(-n_boot // 8)
        raw = b"".join([hashlib.sha256(f"{seed}|{j}|{x}".encode()).digest() for x in items for j in range(blocks)])
        return np.searchsorted(cuts, np.frombuffer(raw, ">u4").reshape(len(items), 8 * blocks)[:, :n_boot], side="right").astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(n_boot), np.zeros(n_boot)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            v = batch.column(1).to_numpy(zero_copy_only=False)
            of = np.bincount(codes, weights=v, minlength=len(names)), np.bincount(codes, minlength=len(names))
            for at in range(0, len(names), 1024):
                w = weights(names[at : at + 1024])
                sums += of[0][at : at + 1024] @ w
                counts += of[1][at : at + 1024] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), pa.array(sums), pa.array(counts)], ["b", "s", "c"])

    used = rows.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    draws = used.mapInArrow(run, "b long, s double, c double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    means = draws.where("c > 0").agg(F.array_sort(F.collect_list(F.col("s") / F.col("c"))).alias("all"))
    n = F.size("all")
    at = (lambda q: F.floor(q * (n - 1))) if index == "last" else (lambda q: F.least(n - 1, F.floor(q * n)))
    return means.select(F.get("all", at(0.025).cast("int")).alias("low"), F.get("all", at(0.975).cast("int")).alias("high"))


def wilson_by(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count_if(F.col(flag)).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumn("low", low).withColumn("high", high)


def costs(tokens: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Calls, tokens and cost per key and together; prices are per million tokens in and out. tokens has n_in, n_out."""
    both = tokens.join(prices, key, "left")
    usd = F.col("n_in") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("n_out") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    return with_all(both.withColumn("usd", usd), key, [F.count("*").alias("calls"), F.sum("n_in").alias("tokens_in"), F.sum("n_out").alias("tokens_out"), F.sum("usd").alias("usd")])


def panel_verdict(votes: DataFrame, item: str, mode: str = "any", least: int = 2) -> DataFrame:
    """(item, truthful, inconclusive, agreement) of votes (truthful, inconclusive); fails closed below `least` usable votes.

    any: one objection is enough; majority: strictly more true than false.
    """
    usable = ~F.coalesce("inconclusive", F.lit(True))
    out = votes.groupBy(item).agg(F.count_if(usable & F.col("truthful")).alias("_t"), F.count_if(usable & ~F.col("truthful")).alias("_f"))
    n = F.col("_t") + F.col("_f")
    ok = (F.col("_f") == 0) if mode == "any" else (F.col("_t") > F.col("_f"))
    return out.select(item, ((n >= least) & ok).alias("truthful"), (n < least).alias("inconclusive"), F.when(n > 0, F.round(F.greatest("_t", "_f") / n, 4)).alias("agreement"))


def three_rules(votes: DataFrame, item: str) -> DataFrame:
    """all, strict majority and at least one of the votes, for each item."""
    k, n = F.count_if("truthful"), F.count("truthful")
    return votes.groupBy(item).agg((k == n).alias("by_all"), (k * 2 > n).alias("by_majority"), (k > 0).alias("by_one"), ((k == 0) | (k == n)).alias("unanimous"))


def upper_median(rows: DataFrame, by: str, value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """The value at place n // 2 of the sorted values, and at int(q * n): not interpolated.

    Places come from cells of the value and ranks inside them, so no group is in one task.
    """
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    ranked = places(rows, [by], value, [], "_r").join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_r", F.col("_r") - 1)
    at = lambda place: F.max(F.when(F.col("_r") == place, F.col(value)))
    named = {name: at(F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))) for name, q in (quantiles or {}).items()}
    return ranked.groupBy(by).agg(at(F.floor(F.col("_n") / 2)).alias("median"), *[c.alias(n) for n, c in named.items()])


def head_to_head(rows: DataFrame, score: list[str]) -> DataFrame:
    """Wins, losses and ties of struct(score) against rival_score."""
    mine = F.struct(*score)
    return rows.agg(F.count_if(mine > F.col("rival_score")).alias("wins"), F.count_if(mine < F.col("rival_score")).alias("losses"), F.count_if(mine == F.col("rival_score")).alias("ties"))


def pairwise(items: DataFrame, item: str, member: str, value: str, us: int, them: int) -> DataFrame:
    """Wins, losses, ties of us against them by item mean (lower is better), the mean advantage, the rate without ties."""
    wide = items.where(F.col(member).isin(us, them)).groupBy(item).agg(F.avg(F.when(F.col(member) == us, F.col(value))).alias("u"), F.avg(F.when(F.col(member) == them, F.col(value))).alias("t")).where("u is not null and t is not null")
    out = wide.agg(F.count_if(F.col("u") < F.col("t")).alias("wins"), F.count_if(F.col("u") > F.col("t")).alias("losses"), F.count_if(F.col("u") == F.col("t")).alias("ties"), F.avg(F.col("t") - F.col("u")).alias("advantage"))
    return out.withColumn("rate", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))))


def two_by_two(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.when(F.col(a) & F.col(b), "both").when(F.col(a), "first").when(F.col(b), "second").otherwise("neither").alias("cell")).agg(F.count("*").alias("n"))


def paired_arms(rows: DataFrame, item: str, arm: str, flag: str, first: str, second: str) -> DataFrame:
    """2 x 2 counts over items in both arms, and the rate difference."""
    of = lambda x: F.bool_or(F.when(F.col(arm) == x, F.col(flag)))
    both = rows.groupBy(item).agg(of(first).alias("x"), of(second).alias("y")).where("x is not null and y is not null")
    return both.agg(F.count_if(F.expr("x and y")).alias("both"), F.count_if(F.expr("x and not y")).alias("only_first"), F.count_if(F.expr("not x and y")).alias("only_second"), F.count_if(F.expr("not x and not y")).alias("neither"), (F.avg(F.col("y").cast("double")) - F.avg(F.col("x").cast("double"))).alias("delta"))


def litmus(table: DataFrame, member: str, us: int, rank: str, fit: str) -> DataFrame:
    """For each other member: whether ours matches it (rank no higher and fit no lower); nulls never match."""
    ours = table.where(F.col(member) == us).select(F.col(rank).alias("_r"), F.col(fit).alias("_f"))
    return table.where(F.col(member) != us).crossJoin(F.broadcast(ours)).select(member, F.coalesce((F.col("_r") <= F.col(rank)) & (F.col("_f") >= F.col(fit)), F.lit(False)).alias("matches"))


def no_regression(metrics: DataFrame, baseline: DataFrame, key: str, slack: float = 1e-9) -> DataFrame:
    """(ok): every metric is at least the baseline's. metrics has (key, value, higher_is_better)."""
    b = baseline.select(key, F.col("value").alias("_b"))
    turned = F.when(F.col("higher_is_better"), F.col("value") - F.col("_b")).otherwise(F.col("_b") - F.col("value"))
    return metrics.join(b, key).agg(F.bool_and(turned >= -slack).alias("ok"))


def attempts_to_clean(rows: DataFrame, attempts: str, fallback: str) -> DataFrame:
    label = F.when(F.col(fallback), "fallback").otherwise(F.concat(F.lit("pass@"), F.col(attempts).cast("string")))
    return rows.groupBy(label.alias("outcome")).agg(F.count("*").alias("n"))


def leaderboard(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, by the columns down, nulls as -1, then by the remaining columns."""
    keys = [F.coalesce(F.col(c), F.lit(-1)).desc() for c in order]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*keys)))
