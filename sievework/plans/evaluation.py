"""Queries over scored outputs: rates, ranks, intervals, panels, costs, head-to-heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import buckets as B
from sievework.operators import joins as J
from sievework.operators import metrics as M
from sievework.plans.fixtures import FACT, fact
from sievework.plans.registry import query
from sievework.session import table

LEVELS = ["beginner", "intermediate", "advanced"]
_LEVELS = "levels(level) AS (VALUES ('beginner'), ('intermediate'), ('advanced'))"


def r6(c) -> F.Column:
    return F.round(c, 6)


@query(f"""WITH {FACT}, {_LEVELS}, models AS (SELECT range AS model FROM range(0, 14)),
  r AS (SELECT model, level, count(*) AS n, round(avg(sound::INT), 6) AS sound_rate, round(avg(fit::INT), 6) AS fit_rate, round(avg(fabricated::INT), 6) AS fabrication_rate FROM fact GROUP BY ALL)
  SELECT model, level, n, sound_rate, fit_rate, fabrication_rate FROM models CROSS JOIN levels LEFT JOIN r USING (model, level)""")
def cond_rates_grid(spark, sf) -> DataFrame:
    rates = fact(spark, sf).groupBy("model", "level").agg(F.count("*").alias("n"), r6(M.rate("sound")).alias("sound_rate"), r6(M.rate("fit")).alias("fit_rate"), r6(M.rate("fabricated")).alias("fabrication_rate"))
    return M.dense(rates, spark.range(14).select(F.col("id").alias("model")), spark.createDataFrame([(x,) for x in LEVELS], "level string"))


@query(f"""WITH {FACT} SELECT model, coalesce(level, 'ALL') AS level, count(*) AS n, round(avg(sound::INT), 6) AS sound_rate FROM fact GROUP BY GROUPING SETS ((model, level), (model))""")
def rates_by_level_and_overall(spark, sf) -> DataFrame:
    out = fact(spark, sf).groupingSets([["model", "level"], ["model"]], "model", "level").agg(F.count("*").alias("n"), r6(M.rate("sound")).alias("sound_rate"))
    return out.withColumn("level", F.coalesce("level", F.lit("ALL")))


@query(f"""WITH {FACT} SELECT coalesce(level, 'ALL') AS level, count(*) AS n, round(avg(grade), 6) AS mean_grade, CAST(median(tokens) AS DOUBLE) AS median_tokens, round(avg(CASE WHEN sound THEN fit::INT END), 6) AS fit_if_sound, count(*) FILTER (WHERE fabricated) AS n_fabricated FROM fact GROUP BY ROLLUP (level)""")
def rates_with_all_group(spark, sf) -> DataFrame:
    return M.with_all(fact(spark, sf), "level", [F.count("*").alias("n"), r6(F.avg("grade")).alias("mean_grade"), F.median("tokens").alias("median_tokens"), r6(M.rate(F.when(F.col("sound"), F.col("fit")))).alias("fit_if_sound"), F.count_if("fabricated").alias("n_fabricated")])


@query(f"""WITH {FACT} SELECT item, model, level, rank() OVER g + (count(*) OVER (PARTITION BY item, grade) - 1) / 2 AS rank, rank() OVER g = 1 AS top FROM fact WHERE grade IS NOT NULL WINDOW g AS (PARTITION BY item ORDER BY grade DESC)""")
def average_tie_rank(spark, sf) -> DataFrame:
    return M.average_tie_rank(fact(spark, sf).where("grade is not null"), ["item"], "grade").select("item", "model", "level", "rank", "top")


_RANKS = """ranks AS (SELECT item, model, item % 3 AS judge, row_number() OVER (PARTITION BY item ORDER BY coalesce(grade, -1) DESC, model, level) AS rank FROM fact)"""


def ranks(spark, sf) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("grade", F.lit(-1)).desc(), "model", "level"))
    return fact(spark, sf).select("item", "model", (F.col("item") % 3).alias("judge"), place.cast("long").alias("rank"))


@query(f"""WITH {FACT}, {_RANKS} SELECT model, round(avg(rank), 6) AS raw, round(avg(rank) FILTER (WHERE judge <> model), 6) AS corrected, round(avg((rank = 1)::INT), 6) AS first_share, round((avg(rank) FILTER (WHERE judge <> model) - 1) / 6, 6) AS normal FROM ranks GROUP BY model""")
def mean_rank_corrected(spark, sf) -> DataFrame:
    out = M.corrected_ranks(ranks(spark, sf), "judge", "model", "rank", 7)
    return out.select("model", *[r6(F.col(c)).alias(c) for c in ("raw", "corrected", "first_share", "normal")])


@query(f"""WITH {FACT}, {_RANKS} SELECT model, round(avg(rank) FILTER (WHERE judge <> model) - avg(rank) FILTER (WHERE judge = model), 6) AS others_minus_own, round(avg(rank) FILTER (WHERE judge = model) - avg(rank) FILTER (WHERE judge <> model), 6) AS own_minus_others FROM ranks WHERE model < 3 GROUP BY model""")
def self_preference(spark, sf) -> DataFrame:
    return M.self_preference(ranks(spark, sf), "judge", "model", "rank").select("model", r6(F.col("others_minus_own")).alias("others_minus_own"), r6(F.col("own_minus_others")).alias("own_minus_others"))


@query(f"""WITH {FACT}, {_RANKS}, c AS (SELECT item, count(*) AS n FROM fact GROUP BY item) SELECT model, round(avg((rank - 1) / (n - 1)), 6) AS normal FROM ranks JOIN c USING (item) WHERE n > 1 GROUP BY model""")
def mean_of_row_normalised_ranks(spark, sf) -> DataFrame:
    sized = ranks(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("item"))).where("n > 1")
    return sized.groupBy("model").agg(r6(F.avg((F.col("rank") - 1) / (F.col("n") - 1))).alias("normal"))


@query(f"""WITH {FACT}, {_RANKS}, f AS (SELECT item, m.model, coalesce(rank, (SELECT count(*) FROM ranks z WHERE z.item = i.item)) AS rank FROM (SELECT DISTINCT item FROM ranks) i CROSS JOIN (SELECT range AS model FROM range(12)) m LEFT JOIN (SELECT item, model, min(rank) AS rank FROM ranks GROUP BY ALL) USING (item, model))
  SELECT model, round(avg(rank), 6) AS mean_rank FROM f GROUP BY model""")
def worst_rank_for_missing(spark, sf) -> DataFrame:
    rows = ranks(spark, sf)
    sizes = rows.groupBy("item").agg(F.count("*").alias("size"))
    grid = sizes.crossJoin(F.broadcast(spark.range(12).select(F.col("id").alias("model"))))
    own = rows.groupBy("item", "model").agg(F.min("rank").alias("rank"))
    return grid.join(own, ["item", "model"], "left").groupBy("model").agg(r6(F.avg(F.coalesce("rank", "size"))).alias("mean_rank"))


_BOOT = """draws AS (SELECT b, i, CAST('0x' || substr(sha256('7|' || b || '|' || i), 1, 8) AS BIGINT) % 25 AS k FROM range(200) x(b), range(25) y(i)),
  items AS (SELECT CAST(c_nationkey AS BIGINT) AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), means AS (SELECT b, avg(v) AS m FROM draws JOIN items USING (k) GROUP BY b), s AS (SELECT list_sort(list(m)) AS a FROM means)"""


@query(f"WITH {_BOOT} SELECT round(a[1 + CAST(floor(0.025 * 199) AS INT)], 3) AS low, round(a[1 + CAST(floor(0.975 * 199) AS INT)], 3) AS high FROM s")
def bootstrap_ci_hash(spark, sf) -> DataFrame:
    items = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    return M.bootstrap(items, "k", "v", 200, 25, 7).select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"WITH {_BOOT} SELECT round(a[1 + CAST(floor(0.025 * 200) AS INT)], 3) AS low, round(a[1 + CAST(floor(0.975 * 200) AS INT)], 3) AS high FROM s")
def bootstrap_ci_count_index(spark, sf) -> DataFrame:
    items = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    return M.bootstrap(items, "k", "v", 200, 25, 7, "count").select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


_W = "1.96 * 1.96"


@query(f"""WITH g AS (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
  SELECT lang, k, n, round(greatest(0, (k / n + {_W} / (2 * n)) / (1 + {_W} / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + {_W} / (4 * n * n)) / (1 + {_W} / n)), 6) AS low,
    round(least(1, (k / n + {_W} / (2 * n)) / (1 + {_W} / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + {_W} / (4 * n * n)) / (1 + {_W} / n)), 6) AS high FROM g""")
def wilson_interval(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").withColumn("flag", F.col("toxic") == 1)
    return M.wilson_by(rows, ["lang"], "flag").select("lang", "k", "n", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("""WITH t AS (SELECT p_brand AS brand, CAST(floor(l_quantity) AS BIGINT) * 100 AS n_in, CAST(floor(l_extendedprice) AS BIGINT) AS n_out, CAST(substr(p_brand, 7) AS INT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
  c AS (SELECT brand, n_in, n_out, CASE WHEN b <= 20 THEN n_in * (b / 10) + n_out * (b / 5) ELSE 0 END AS micro FROM t)
  SELECT coalesce(brand, 'ALL') AS brand, count(*) AS calls, CAST(sum(n_in) AS BIGINT) AS tokens_in, CAST(sum(n_out) AS BIGINT) AS tokens_out, round(sum(micro) / 1e6, 4) AS usd FROM c GROUP BY ROLLUP (brand)""")
def token_cost_rollup(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    tokens = table(spark, sf, "lineitem").select("l_partkey", (F.floor("l_quantity") * 100).alias("n_in"), F.floor("l_extendedprice").alias("n_out")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("brand", "n_in", "n_out")
    prices = spark.createDataFrame([(f"Brand#{i}", i / 10, i / 5) for i in range(1, 21)], "brand string, price_in double, price_out double")
    return M.costs(tokens, prices, "brand").withColumn("usd", F.round("usd", 4))


@query(f"""WITH {FACT}, p AS (SELECT model, level, sum(fit::INT) AS k, count(*) AS n FROM fact GROUP BY ALL) SELECT model, round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro FROM p GROUP BY model""")
def macro_micro_rates(spark, sf) -> DataFrame:
    return M.macro(fact(spark, sf), ["model"], "level", "fit").select("model", r6(F.col("macro")).alias("macro"), r6(F.col("micro")).alias("micro"))


@query(f"""WITH {FACT}, w AS (SELECT item, max(pick) FILTER (WHERE level = 'beginner') AS pb, max(pick) FILTER (WHERE level = 'advanced') AS pa, max(best) FILTER (WHERE level = 'beginner') AS tb, max(best) FILTER (WHERE level = 'advanced') AS ta FROM fact GROUP BY item)
  SELECT count(*) AS opportunities, count(*) FILTER (WHERE pb <> pa) AS distinct_picks FROM w WHERE tb <> ta""")
def distinct_rate_all_opportunity(spark, sf) -> DataFrame:
    return M.distinct_rate(fact(spark, sf), "item", "level", "pick", "best")


@query(f"""WITH {FACT}, w AS (SELECT item, max(pick) FILTER (WHERE level = 'beginner') AS b, max(pick) FILTER (WHERE level = 'intermediate') AS i, max(pick) FILTER (WHERE level = 'advanced') AS a FROM fact GROUP BY item)
  SELECT count(*) AS items, count(*) FILTER (WHERE b = a AND i <> b) AS zigzag, count(*) FILTER (WHERE b < a) AS inverted, count(*) FILTER (WHERE b = i AND i = a) AS flat, count(*) FILTER (WHERE (b = a AND i <> b) OR b < a OR (b = i AND i = a)) AS violations FROM w WHERE b IS NOT NULL AND i IS NOT NULL AND a IS NOT NULL""")
def coherence_violations(spark, sf) -> DataFrame:
    return M.coherence(fact(spark, sf), "item", "level", "pick")


@query("""WITH s AS (SELECT c_custkey, c_acctbal / 10000 AS a, avg(o_totalprice) / 500000 AS b, CASE WHEN count(o_orderkey) > 0 THEN count(*) / 40 END AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY ALL)
  SELECT c_custkey, round((.45 * a + coalesce(.45 * b, 0) + coalesce(.10 * c, 0)) / (.45 + CASE WHEN b IS NULL THEN 0 ELSE .45 END + CASE WHEN c IS NULL THEN 0 ELSE .10 END), 6) AS score FROM s""")
def null_renormalised_score(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg((F.avg("o_totalprice") / 500000).alias("b"), (F.count("*") / 40).alias("c"))
    rows = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", r6(B.weighted_mean([(F.col("c_acctbal") / 10000, 0.45), (F.col("b"), 0.45), (F.col("c"), 0.10)])).alias("score"))


@query(f"""WITH {FACT}, p AS (SELECT item, model, round(avg(grade), 2) AS m FROM fact GROUP BY ALL) SELECT model, round(avg(m), 6) AS mean FROM p GROUP BY model""")
def mean_of_rounded_means(spark, sf) -> DataFrame:
    return M.mean_of_rounded(fact(spark, sf), ["item"], "model", "grade").withColumn("mean", r6(F.col("mean")))


_VOTES = "votes AS (SELECT item, model, sound AS truthful, grade IS NULL AS inconclusive FROM fact)"


def votes(spark, sf) -> DataFrame:
    return fact(spark, sf).select("item", "model", F.col("sound").alias("truthful"), F.col("grade").isNull().alias("inconclusive"))


@query(f"""WITH {FACT}, {_VOTES}, p AS (SELECT item, count(*) FILTER (WHERE NOT inconclusive AND truthful) AS t, count(*) FILTER (WHERE NOT inconclusive AND NOT truthful) AS f FROM votes GROUP BY item)
  SELECT item, t + f >= 2 AND t > f AS truthful, t + f < 2 AS inconclusive, CASE WHEN t + f > 0 THEN round(greatest(t, f) / (t + f), 4) END AS agreement FROM p""")
def panel_verdict(spark, sf) -> DataFrame:
    return M.panel_verdict(votes(spark, sf), "item", "majority")


@query(f"""WITH {FACT}, {_VOTES} SELECT item, bool_and(truthful) AS by_all, count(*) FILTER (WHERE truthful) * 2 > count(*) AS by_majority, bool_or(truthful) AS by_one, bool_and(truthful) OR NOT bool_or(truthful) AS unanimous FROM votes GROUP BY item""")
def three_panel_rules(spark, sf) -> DataFrame:
    return M.three_rules(votes(spark, sf), "item")


@query("SELECT lang, bool_or(toxic = 1) AS any_flagged, count(*) > 0 AND bool_and(toxic = 1) AS both_flagged, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source ORDER BY 1")
def any_all_flags(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("lang", "source").agg(F.bool_or(F.col("toxic") == 1).alias("any_flagged"), F.bool_and(F.col("toxic") == 1).alias("both_flagged"), F.count("*").alias("n")).drop("source")


_BEST = """r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY fit DESC, sound DESC, model) AS n FROM cells), t AS (SELECT item, max(model) FILTER (WHERE n = 1) AS m1, max(model) FILTER (WHERE n = 2) AS m2 FROM r GROUP BY item),
  b AS (SELECT c.item, c.model, c.fit, c.sound, CASE WHEN c.model = m1 THEN m2 ELSE m1 END AS rival FROM cells c JOIN t USING (item)),
  v AS (SELECT b.*, o.fit AS rfit, o.sound AS rsound FROM b LEFT JOIN cells o ON o.item = b.item AND o.model = b.rival)"""
_CELLS = "cells AS (SELECT item, model, max(fit::INT) AS fit, max(sound::INT) AS sound FROM fact GROUP BY ALL)"


def cells(spark, sf) -> DataFrame:
    return fact(spark, sf).groupBy("item", "model").agg(F.max(F.col("fit").cast("int")).alias("fit"), F.max(F.col("sound").cast("int")).alias("sound"))


@query(f"""WITH {FACT}, {_CELLS}, {_BEST} SELECT model, count(*) FILTER (WHERE (fit, sound) > (rfit, rsound)) AS wins, count(*) FILTER (WHERE (fit, sound) < (rfit, rsound)) AS losses, count(*) FILTER (WHERE fit = rfit AND sound = rsound) AS ties FROM v WHERE rival IS NOT NULL GROUP BY model""")
def head_to_head_wlt(spark, sf) -> DataFrame:
    rows = J.best_other(cells(spark, sf), "item", "model", ["fit", "sound"]).where("rival is not null")
    mine = F.struct("fit", "sound")
    return rows.groupBy("model").agg(F.count_if(mine > F.col("rival_score")).alias("wins"), F.count_if(mine < F.col("rival_score")).alias("losses"), F.count_if(mine == F.col("rival_score")).alias("ties"))


@query(f"""WITH {FACT}, w AS (SELECT item, avg(grade) FILTER (WHERE model = 1) AS u, avg(grade) FILTER (WHERE model = 5) AS t FROM fact GROUP BY item), x AS (SELECT count(*) FILTER (WHERE u < t) AS wins, count(*) FILTER (WHERE u > t) AS losses, count(*) FILTER (WHERE u = t) AS ties, round(avg(t - u), 6) AS advantage FROM w WHERE u IS NOT NULL AND t IS NOT NULL)
  SELECT *, round(wins / (wins + losses), 6) AS rate FROM x""")
def pairwise_record(spark, sf) -> DataFrame:
    out = M.pairwise(fact(spark, sf), "item", "model", "grade", 1, 5)
    return out.withColumn("advantage", r6(F.col("advantage"))).withColumn("rate", r6(F.col("rate")))


@query("SELECT lang, arr[1 + len(arr) // 2] AS median, arr[1 + CAST(floor(len(arr) * 0.1) AS BIGINT)] AS p10, arr[1 + least(len(arr) - 1, CAST(floor(len(arr) * 0.9) AS BIGINT))] AS p90 FROM (SELECT lang, list_sort(list(n_chars)) AS arr FROM documents GROUP BY lang)")
def upper_median(spark, sf) -> DataFrame:
    return M.upper_median(table(spark, sf, "documents").select("lang", "n_chars"), "lang", "n_chars", {"p10": 0.1, "p90": 0.9})


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3) GROUP BY 1")
def completeness_division(spark, sf) -> DataFrame:
    return J.complete_items(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", 3).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN v THEN 'fallback' ELSE 'pass@' || k END AS outcome, count(*) AS n FROM (SELECT event_id % 6 + 1 AS k, event_type = 'error' AS v FROM events) GROUP BY 1")
def attempts_distribution(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("event_id") % 6 + 1).alias("k"), (F.col("event_type") == "error").alias("v"))
    return M.attempts_to_clean(rows, "k", "v")


@query(f"""WITH {FACT} SELECT CASE WHEN sound AND fit THEN 'both' WHEN sound THEN 'first' WHEN fit THEN 'second' ELSE 'neither' END AS cell, count(*) AS n FROM fact GROUP BY 1""")
def two_by_two_value(spark, sf) -> DataFrame:
    return M.two_by_two(fact(spark, sf), "sound", "fit")


@query(f"""WITH {FACT}, b AS (SELECT item, bool_or(fit) FILTER (WHERE level = 'beginner') AS x, bool_or(fit) FILTER (WHERE level = 'advanced') AS y FROM fact GROUP BY item)
  SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_first, count(*) FILTER (WHERE NOT x AND y) AS only_second, count(*) FILTER (WHERE NOT x AND NOT y) AS neither, round(avg(y::INT) - avg(x::INT), 6) AS delta FROM b WHERE x IS NOT NULL AND y IS NOT NULL""")
def paired_contingency(spark, sf) -> DataFrame:
    return M.paired_arms(fact(spark, sf), "item", "level", "fit", "beginner", "advanced").withColumn("delta", r6(F.col("delta")))


@query(f"""WITH {FACT}, {_RANKS}, t AS (SELECT r.model, round(avg(rank), 6) AS rank, round(max(f), 6) AS fit FROM ranks r JOIN (SELECT model, avg(fit::INT) AS f FROM fact GROUP BY 1) USING (model) GROUP BY r.model)
  SELECT model, coalesce((SELECT rank FROM t WHERE model = 4) <= rank AND (SELECT fit FROM t WHERE model = 4) >= fit, false) AS matches FROM t WHERE model <> 4""")
def litmus_comparison(spark, sf) -> DataFrame:
    fits = fact(spark, sf).groupBy("model").agg(r6(M.rate("fit")).alias("fit"))
    both = ranks(spark, sf).groupBy("model").agg(r6(F.avg("rank")).alias("rank")).join(fits, "model")
    return M.litmus(both, "model", 4, "rank", "fit")


@query(f"""WITH {FACT}, m AS (SELECT level, avg(fit::INT) AS v, avg(fabricated::INT) AS w FROM fact WHERE model = 1 GROUP BY 1), o AS (SELECT level, avg(fit::INT) AS v, avg(fabricated::INT) AS w FROM fact WHERE model = 2 GROUP BY 1)
  SELECT bool_and(m.v - o.v >= -1e-9 AND o.w - m.w >= -1e-9) AS ok FROM m JOIN o USING (level)""")
def no_regression_check(spark, sf) -> DataFrame:
    def of(model):
        g = fact(spark, sf).where(F.col("model") == model).groupBy("level").agg(M.rate("fit").alias("v"), M.rate("fabricated").alias("w"))
        both = F.array(F.struct(F.concat("level", F.lit("/fit")).alias("metric"), F.col("v").alias("value"), F.lit(True).alias("higher_is_better")), F.struct(F.concat("level", F.lit("/fab")).alias("metric"), F.col("w").alias("value"), F.lit(False).alias("higher_is_better")))
        return g.select(F.inline(both))

    return M.no_regression(of(1), of(2), "metric")


@query(f"""WITH {FACT}, q AS (SELECT item, model, level, 2 * fit::INT + sound::INT - 2 * fabricated::INT + coalesce(grade / 5, 0) AS q FROM fact) SELECT model, round(avg(q), 6) AS quality, count(*) AS n, count(*) < (SELECT max(n) FROM (SELECT count(*) AS n FROM q GROUP BY model)) AS partial FROM q GROUP BY model""")
def live_leaderboard(spark, sf) -> DataFrame:
    q = B.cell_quality(F.col("sound"), F.col("fit"), F.col("fabricated"), F.col("grade"), F.lit(None))
    out = fact(spark, sf).groupBy("model").agg(r6(F.avg(q)).alias("quality"), F.count("*").alias("n"))
    return out.withColumn("partial", F.col("n") < F.max("n").over(Window.partitionBy(F.lit(1))))


@query(f"""WITH {FACT}, p AS (SELECT model, avg(fit::INT) AS fit, avg(sound::INT) AS sound FROM fact GROUP BY 1) SELECT model, round(fit, 6) AS fit, row_number() OVER (ORDER BY CASE WHEN model = 3 THEN -1 ELSE fit END DESC, sound DESC, model) AS place FROM p""")
def leaderboard_order(spark, sf) -> DataFrame:
    p = fact(spark, sf).groupBy("model").agg(M.rate("fit").alias("fit"), M.rate("sound").alias("sound")).withColumn("shown", F.when(F.col("model") != 3, F.col("fit"))).withColumn("minus", -F.col("model"))
    return M.leaderboard(p, ["shown", "sound", "minus"]).select("model", r6(F.col("fit")).alias("fit"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {FACT}, s AS (SELECT model, sound OR tokens % 500 < 250 AS safe, tokens % 500 AS loss, item, level FROM fact) SELECT model, count(*) AS n, round(avg(safe::INT), 6) AS safe_rate FROM s GROUP BY model""")
def safety_rate(spark, sf) -> DataFrame:
    safe = F.col("sound") | (F.col("tokens") % 500 < B.BLUNDER)
    return fact(spark, sf).groupBy("model").agg(F.count("*").alias("n"), r6(M.rate(safe)).alias("safe_rate"))


@query(f"""WITH {FACT} SELECT item, model, level, tokens % 500 AS loss FROM fact WHERE NOT sound ORDER BY tokens % 500 DESC, item, model, level LIMIT 12""")
def safety_worst_twelve(spark, sf) -> DataFrame:
    return fact(spark, sf).where("not sound").select("item", "model", "level", (F.col("tokens") % 500).alias("loss")).orderBy(F.desc("loss"), "item", "model", "level").limit(12)


@query("SELECT o_orderpriority AS category, count(*) FILTER (WHERE o_orderstatus = 'O') AS held, count(*) FILTER (WHERE o_orderstatus = 'P') AS wobbled, count(*) FILTER (WHERE o_orderstatus = 'F') AS broke FROM orders GROUP BY 1")
def robustness_scorecard(spark, sf) -> DataFrame:
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("category")).pivot("o_orderstatus", ["O", "P", "F"]).count()
    return wide.select("category", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("O", "held"), ("P", "wobbled"), ("F", "broke"))])


@query("""SELECT axis, value, count(*) AS n FROM (SELECT unnest(['lang', 'source', 'band']) AS axis, unnest([lang, source, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END]) AS value FROM documents) GROUP BY ALL""")
def distribution_by_axis(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("band"))
    g = docs.groupingSets([["lang"], ["source"], ["band"]], "lang", "source", "band").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, "lang").when(F.col("g") == 5, "source").otherwise("band").alias("axis"), F.coalesce("lang", "source", "band").alias("value"), "n")


@query("""SELECT count(*) AS n, min(p_size) AS low, max(p_size) AS high, count(*) FILTER (WHERE p_size < 10) AS under_ten, round(count(p_type) / count(*), 6) AS filled, count(DISTINCT p_type) AS types FROM part""")
def profile_pass(spark, sf) -> DataFrame:
    return table(spark, sf, "part").agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.count_if(F.col("p_size") < 10).alias("under_ten"), F.round(F.count("p_type") / F.count("*"), 6).alias("filled"), F.countDistinct("p_type").alias("types"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def profile_top_tags(spark, sf) -> DataFrame:
    tags = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query(f"""WITH {FACT}, {_CELLS}, x AS (SELECT a.item, a.model, bool_or(b.fit > a.fit OR b.sound > a.sound) AS loses, bool_or(b.fit < a.fit OR b.sound < a.sound) AS wins FROM cells a JOIN cells b ON a.item = b.item AND a.model <> b.model GROUP BY ALL)
  SELECT model, count(*) FILTER (WHERE wins) AS wins, count(*) FILTER (WHERE loses) AS losses FROM x GROUP BY model""")
def any_rival_flags(spark, sf) -> DataFrame:
    # A rival that is better exists iff the item's best is above the own value; so no self-join is needed.
    w = Window.partitionBy("item")
    rows = cells(spark, sf).select("item", "model", *[(f(c).over(w) != F.col(c)).alias(f"{n}_{c}") for c in ("fit", "sound") for f, n in ((F.max, "above"), (F.min, "below"))], F.count("*").over(w).alias("n")).where("n > 1")
    return rows.groupBy("model").agg(F.count_if(F.col("below_fit") | F.col("below_sound")).alias("wins"), F.count_if(F.col("above_fit") | F.col("above_sound")).alias("losses"))


@query(f"""WITH {FACT}, m AS (SELECT model, avg(fit::INT) AS f, avg(sound::INT) AS s, avg(fabricated::INT) AS b FROM fact GROUP BY 1) SELECT round(avg(f), 6) AS fit, avg(f) >= .60 AS fit_ok, avg(s) >= .60 AS sound_ok, avg(b) <= .25 AS fabrication_ok FROM m""")
def threshold_verdict(spark, sf) -> DataFrame:
    m = fact(spark, sf).groupBy("model").agg(M.rate("fit").alias("f"), M.rate("sound").alias("s"), M.rate("fabricated").alias("b"))
    return m.agg(r6(F.avg("f")).alias("fit"), (F.avg("f") >= 0.60).alias("fit_ok"), (F.avg("s") >= 0.60).alias("sound_ok"), (F.avg("b") <= 0.25).alias("fabrication_ok"))


@query(f"""WITH {FACT}, w AS (SELECT item, count(DISTINCT level) AS levels, count(DISTINCT pick) FILTER (WHERE sound) AS moves, max(pick) FILTER (WHERE level = 'beginner') AS b, max(pick) FILTER (WHERE level = 'advanced') AS a FROM fact GROUP BY item) SELECT item, moves FROM w WHERE levels = 3 AND moves >= 2 AND b >= a""")
def showcase_filter(spark, sf) -> DataFrame:
    of = lambda x: F.max(F.when(F.col("level") == x, F.col("pick")))
    w = fact(spark, sf).groupBy("item").agg(F.countDistinct("level").alias("levels"), F.countDistinct(F.when(F.col("sound"), F.col("pick"))).alias("moves"), of("beginner").alias("b"), of("advanced").alias("a"))
    return w.where("levels = 3 and moves >= 2 and b >= a").select("item", "moves")


@query(f"""WITH {FACT}, s AS (SELECT item, model, sum(2 * fit::INT + sound::INT) AS q FROM fact GROUP BY ALL), d AS (SELECT a.item, sign(a.q - b.q) AS s FROM s a JOIN s b ON a.item = b.item AND a.model = 1 AND b.model = 2) SELECT CASE s WHEN 1 THEN 'beats' WHEN -1 THEN 'trails' ELSE 'even' END AS duel, count(*) AS n FROM d GROUP BY 1""")
def level_duel(spark, sf) -> DataFrame:
    q = fact(spark, sf).groupBy("item", "model").agg(F.sum(2 * F.col("fit").cast("int") + F.col("sound").cast("int")).alias("q"))
    both = q.where("model = 1").select("item", F.col("q").alias("u")).join(q.where("model = 2").select("item", F.col("q").alias("t")), "item")
    return both.groupBy(F.when(F.col("u") > F.col("t"), "beats").when(F.col("u") < F.col("t"), "trails").otherwise("even").alias("duel")).agg(F.count("*").alias("n"))
