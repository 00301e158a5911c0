"""Queries over picks by level: differences, mirrors, gaps, directions; audits of modal picks; tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import buckets as B
from sievework.functions import text as T
from sievework.functions.buckets import LEVELS
from sievework.operators import divergence as D
from sievework.plans.coaching import BOARDS, _R, rows as coached
from sievework.plans.fixtures import FACT, POOL, fact, pool
from sievework.plans.registry import query
from sievework.session import table


def r6(x) -> F.Column:
    return F.round(x, 6)


def picks(spark, sf) -> DataFrame:
    """Picks of two models at three levels on every order, by arithmetic on its key; some are missing, some unknown."""
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(t).alias("t"), F.lit(m).alias("m")) for t, x in enumerate(LEVELS) for m in (0, 1)]))
    k, t, m = F.col("k"), F.col("t"), F.col("m")
    p = F.when((k + t) % 13 != 0, (k * 7 + t * (k % 3) + m * k) % 5)
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), grid.alias("g")).select("k", "g.level", "g.t", "g.m").where((k + F.col("t") * 5 + F.col("m")) % 11 != 0).withColumn("pick", p)
    return base.select(
        F.concat(F.lit("m"), m.cast("string")).alias("model"), k.alias("pos"), "level", "pick", (k % 5).alias("best"), ((k + t) % 5).alias("canonical"), ((k + 2 * t) % 5).alias("level_pick"), ((k + t * m) % 5).alias("human"),
        ((F.col("pick") * 2 + t) % 5).alias("rank"), ((k % 5 * 2 + t) % 5).alias("best_rank"), ((F.col("pick") + 3) % 5).alias("order_rank"), F.when(F.col("pick") != 4, (F.col("pick") + 1) * (t + 2) % 7).alias("policy"), F.when(k % 5 != 3, (k % 5 + 1) * (t + 2) % 7).alias("best_policy"),
        ((k + m + t) % 4 != 3).alias("genuine"), (k % 3 == 0).alias("discriminating"), F.when((k * 3 + t + m) % 6 == 0, 2).otherwise(0).alias("violations"), (k % 3).alias("phase"), (k % 4).alias("severity"),
    )


_P = """b0 AS (SELECT o_orderkey AS k, t, m, ['beginner', 'intermediate', 'advanced'][t + 1] AS level FROM orders, (VALUES (0), (1), (2)) a(t), (VALUES (0), (1)) b(m) WHERE (o_orderkey + t * 5 + m) % 11 <> 0),
  b1 AS (SELECT *, CASE WHEN (k + t) % 13 <> 0 THEN (k * 7 + t * (k % 3) + m * k) % 5 END AS pick FROM b0),
  p AS (SELECT 'm' || m AS model, k AS pos, level, pick, k % 5 AS best, (k + t) % 5 AS canonical, (k + 2 * t) % 5 AS level_pick, (k + t * m) % 5 AS human, (pick * 2 + t) % 5 AS rank, (k % 5 * 2 + t) % 5 AS best_rank, (pick + 3) % 5 AS order_rank,
    CASE WHEN pick <> 4 THEN (pick + 1) * (t + 2) % 7 END AS policy, CASE WHEN k % 5 <> 3 THEN (k % 5 + 1) * (t + 2) % 7 END AS best_policy, (k + m + t) % 4 <> 3 AS genuine, k % 3 = 0 AS discriminating, CASE WHEN (k * 3 + t + m) % 6 = 0 THEN 2 ELSE 0 END AS violations, k % 3 AS phase, k % 4 AS severity FROM b1),
  w AS (SELECT model, pos, count(*) = 3 AS complete, count(DISTINCT pick) AS kinds, count(DISTINCT pick) + CASE WHEN count(pick) < 3 THEN 1 ELSE 0 END AS kinds_null, bool_and(pick IS NOT DISTINCT FROM best) AS mirror, bool_and(coalesce(pick = best, false)) AS mirror_known,
    bool_and(genuine) AS genuine, max(rank) FILTER (WHERE level = 'beginner') AS b, max(rank) FILTER (WHERE level = 'advanced') AS a, max(phase) AS phase, max(severity) AS severity FROM p GROUP BY ALL)"""
_AVG = "round(avg(coalesce({0}, false)::INT) FILTER (WHERE {1}), 6)"


@query(f"""WITH {_P}, l AS (SELECT model, {', '.join(f"round(avg(coalesce(pick = canonical, false)::INT) FILTER (WHERE level = '{x}'), 6) AS fit_{x}, round(avg((pick IS NOT DISTINCT FROM best)::INT) FILTER (WHERE level = '{x}'), 6) AS mirror_{x}, round(avg(coalesce(pick = level_pick, false)::INT) FILTER (WHERE level = '{x}' AND discriminating), 6) AS own_{x}" for x in LEVELS)},
    round(avg(genuine::INT) FILTER (WHERE level = 'beginner'), 6) AS genuine FROM p GROUP BY model),
  f AS (SELECT model, avg(v) AS fit_mean FROM (SELECT model, level, avg(coalesce(pick = canonical, false)::INT) AS v FROM p GROUP BY ALL) GROUP BY model),
  x AS (SELECT model, count(*) AS n_pos, count(*) FILTER (WHERE complete) AS n_full, {_AVG.format('kinds > 1', 'complete')} AS differ, {_AVG.format('mirror', 'complete')} AS mirror_all, round(avg(CASE WHEN b < a THEN 1 WHEN b = a THEN 0.5 ELSE 0 END) FILTER (WHERE complete AND a IS NOT NULL AND b IS NOT NULL), 6) AS direction FROM w GROUP BY model)
  SELECT * REPLACE (round(fit_mean, 6) AS fit_mean) FROM l JOIN f USING (model) JOIN x USING (model)""")
def level_fit_metrics(spark, sf) -> DataFrame:
    out = D.level_metrics(picks(spark, sf))
    return out.select("model", "n_pos", "n_full", *[r6(c).alias(c) for c in out.columns if c not in ("model", "n_pos", "n_full")])


_COUNTS = ", ".join(f"count(*) FILTER (WHERE level = '{x}' AND pick = best) AS best_{x}, count(*) FILTER (WHERE level = '{x}' AND pick = human) AS human_{x}, round(avg(rank) FILTER (WHERE level = '{x}'), 6) AS rank_{x}, round(avg(order_rank) FILTER (WHERE level = '{x}'), 6) AS order_{x}, count(*) FILTER (WHERE level = '{x}' AND rank = 0) AS easiest_{x}" for x in LEVELS)


@query(f"""WITH {_P}, f AS (SELECT p.*, best_rank - rank AS gap FROM p JOIN w USING (model, pos) WHERE complete),
  l AS (SELECT model, {_COUNTS}, sum((violations > 0)::INT)::BIGINT AS n_false, sum(violations)::BIGINT AS violations FROM f GROUP BY model),
  g AS (SELECT model, count(gap) AS gaps, round(avg(gap), 6) AS gap_mean, count(*) FILTER (WHERE gap > 0) AS gap_above, count(*) FILTER (WHERE gap = 0) AS gap_zero, count(*) FILTER (WHERE gap < 0) AS gap_below, round(avg(policy - best_policy) FILTER (WHERE gap IS NOT NULL), 6) AS policy_gap,
    count(*) FILTER (WHERE gap IS NOT NULL AND best_rank > 0) AS open, round(avg(gap) FILTER (WHERE best_rank > 0), 6) AS open_gap, count(*) FILTER (WHERE best_rank > 0 AND rank = 0) AS open_easiest, count(*) FILTER (WHERE gap IS NOT NULL AND best_rank > 0 AND pick = best) AS open_mirror FROM f WHERE level = 'beginner' GROUP BY model),
  x AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE kinds_null = 1) AS kinds_1, count(*) FILTER (WHERE kinds_null = 2) AS kinds_2, count(*) FILTER (WHERE kinds_null = 3) AS kinds_3, count(*) FILTER (WHERE kinds_null > 1) AS differ, count(*) FILTER (WHERE genuine) AS genuine, count(*) FILTER (WHERE genuine AND kinds_null > 1) AS genuine_differ, count(*) FILTER (WHERE mirror_known) AS mirror_all FROM w WHERE complete GROUP BY model)
  SELECT * FROM x JOIN l USING (model) JOIN g USING (model)""")
def findability_gaps(spark, sf) -> DataFrame:
    out = D.gap_metrics(picks(spark, sf))
    return out.select(*[r6(c).alias(c) if kind == "double" else c for c, kind in out.dtypes])


@query(f"""WITH {_P} SELECT model, CASE WHEN coalesce(pick = best, false) AND coalesce(pick = human, false) THEN 'both' WHEN coalesce(pick = best, false) THEN 'best_only' WHEN coalesce(pick = human, false) THEN 'human_only' ELSE 'neither' END AS kind, count(*) AS n FROM p WHERE genuine GROUP BY ALL""")
def pick_value_table(spark, sf) -> DataFrame:
    return D.value_table(picks(spark, sf))


@query(f"""WITH {_P} SELECT p.model, level, count(*) AS n, count(*) FILTER (WHERE pick = human) AS human, count(*) FILTER (WHERE pick = best) AS best, round(avg(order_rank), 6) AS mean_place FROM p JOIN w USING (model, pos) WHERE complete AND w.genuine AND kinds > 1 GROUP BY ALL""")
def divergence_direction(spark, sf) -> DataFrame:
    return D.direction_table(picks(spark, sf)).withColumn("mean_place", r6("mean_place"))


@query(f"""WITH {_P} SELECT 'phase' AS axis, phase::VARCHAR AS value, sum((kinds > 1)::INT)::BIGINT AS differ, count(*) AS n FROM w WHERE complete GROUP BY ALL UNION ALL SELECT 'severity', severity::VARCHAR, sum((kinds > 1)::INT)::BIGINT, count(*) FROM w WHERE complete GROUP BY ALL""")
def divergence_by_axis(spark, sf) -> DataFrame:
    return D.difference_by(picks(spark, sf), ["phase", "severity"])


_MODAL = f"""{FACT}, f AS (SELECT *, item % 500 AS board, 1 + pick % 3 AS pool FROM fact), c AS (SELECT board, level, pick, count(*) AS n, min(item * 100 + model) AS first FROM f GROUP BY ALL),
  m AS (SELECT board, level, pick AS modal, count(*) OVER (PARTITION BY board, level) AS kinds, sum(n) OVER (PARTITION BY board, level) AS total, row_number() OVER (PARTITION BY board, level ORDER BY n DESC, first) AS place FROM c)"""


def _audited(spark, sf) -> DataFrame:
    return fact(spark, sf).withColumns({"board": F.col("item") % 500, "pool": 1 + F.col("pick") % 3, "first": F.col("item") * 100 + F.col("model")})


@query(f"""WITH {_MODAL} SELECT board, level, modal, kinds AS n_kinds, total::BIGINT AS n FROM m WHERE place = 1""")
def audit_modal_picks(spark, sf) -> DataFrame:
    """The most frequent pick of each board and level, the first of equals, and how many others there are."""
    return D.modal_picks(_audited(spark, sf), ["board", "level"], "pick", "first")


@query(f"""WITH {_MODAL}, one AS (SELECT board, max(modal) FILTER (WHERE level = 'beginner') AS b, max(modal) FILTER (WHERE level = 'intermediate') AS i, max(modal) FILTER (WHERE level = 'advanced') AS a, count(*) AS levels FROM m WHERE place = 1 AND level IS NOT NULL GROUP BY board), l AS (SELECT board, min(pool) AS least FROM f GROUP BY board)
  SELECT CASE WHEN b = i AND i = a THEN CASE WHEN least <= 1 THEN 'same_forced' ELSE 'same_missed' END WHEN b = a THEN 'outer_same' ELSE 'different' END AS kind, count(*) AS n FROM one JOIN l USING (board) WHERE levels = 3 GROUP BY 1""")
def all_same_decomposition(spark, sf) -> DataFrame:
    return D.all_same(_audited(spark, sf), "board", "level", "pick", "first", "pool")


DIMS = ("calibration", "clarity", "correctness", "method", "principle", "tone")


@query("""WITH s AS (SELECT l_suppkey % 12 AS model, ['calibration', 'clarity', 'correctness', 'method', 'principle', 'tone'][CAST(1 + l_linenumber % 6 AS INTEGER)] AS dim, CAST(floor(l_quantity) AS BIGINT) % 3 AS score FROM lineitem WHERE NOT (l_suppkey % 12 = 3 AND l_linenumber % 6 = 2)),
  m AS (SELECT model, dim, round(avg(score), 3) AS v, count(*) AS n FROM s GROUP BY ALL)
  SELECT model, """ + ", ".join(f"max(v) FILTER (WHERE dim = '{d}') AS {d}" for d in DIMS) + """, round(sum(v), 3) AS total, max(n) AS n FROM m GROUP BY model""")
def dimension_score_sums(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 12).alias("model"), F.get(F.array(*map(F.lit, DIMS)), (F.col("l_linenumber") % 6).cast("int")).alias("dim"), (F.floor("l_quantity") % 3).alias("score"))
    return D.dimension_means(lines.where(~((F.col("model") == 3) & (F.col("dim") == "correctness"))), "model", DIMS)


@query("""WITH r AS (SELECT o_orderkey AS k, list_filter(['a', 'b', 'c', 'd', 'e'], lambda x, i: (o_orderkey + i) % 4 <> 0) AS ranking FROM orders WHERE o_orderkey % 3 <> 0), e AS (SELECT len(ranking) AS field, unnest(ranking) AS member, generate_subscripts(ranking, 1) - 1 AS place FROM r)
  SELECT member, round(avg(place + 1), 6) AS mean_rank, round(avg(CASE WHEN field > 1 THEN place / (field - 1) ELSE 0 END), 6) AS scaled_rank, round(100 * avg((place = 0)::INT), 6) AS win, count(*) AS n FROM e GROUP BY member""")
def grounded_field_ranks(spark, sf) -> DataFrame:
    """Only rows of one condition count; a rank is scaled by its own row's field."""
    members = F.array(*map(F.lit, "abcde"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.filter(members, lambda x, i: (F.col("o_orderkey") + i + 1) % 4 != 0).alias("ranking"), F.when(F.col("o_orderkey") % 3 != 0, "grounded").otherwise("bare").alias("condition"))
    out = D.field_ranks(rows, "ranking", F.col("condition") == "grounded")
    return out.select("member", r6("mean_rank").alias("mean_rank"), r6("scaled_rank").alias("scaled_rank"), r6("win").alias("win"), "n")


@query(f"""WITH {_P}, x AS (SELECT model AS split, pos, mirror AS mirrors, kinds > 1 AS differs, complete AS covered FROM w)
  SELECT coalesce(split, 'ALL') AS split, count(*) AS n, count(*) FILTER (WHERE mirrors) AS mirrors, count(*) FILTER (WHERE differs) AS differs, count(*) FILTER (WHERE covered) AS covered, bool_and(covered) AS complete FROM x GROUP BY GROUPING SETS ((split), ())""")
def showcase_tallies(spark, sf) -> DataFrame:
    wide = D.by_position(picks(spark, sf), ["pick", "best"])
    mirrors = F.lit(True)
    for x in LEVELS:
        mirrors = mirrors & (F.col(f"at_{x}").isNull() | F.col(f"at_{x}.pick").eqNullSafe(F.col(f"at_{x}.best")))
    kinds = F.size(F.array_distinct(F.filter(F.array(*[F.col(f"at_{x}.pick") for x in LEVELS]), lambda p: p.isNotNull())))
    return D.coverage_tallies(wide.select(F.col("model").alias("split"), "pos", mirrors.alias("mirrors"), (kinds > 1).alias("differs"), F.col("full").alias("covered")), "split", "pos", ["mirrors", "differs", "covered"])


@query(f"""WITH {POOL}, g AS (SELECT gid, max(cp) AS best_cp, bool_or(cp % 97 = 0) AS mate, count(*) FILTER (WHERE agree) AS n_sound, (max(p_b) > max(p_i))::INT + (max(p_a) > 0.1)::INT AS n_disc FROM pool GROUP BY gid) SELECT gid, NOT (mate OR abs(best_cp) >= 500) AND n_sound >= 2 AND n_disc >= 1 AS eligible FROM g""")
def gap_eligibility(spark, sf) -> DataFrame:
    g = pool(spark, sf).groupBy("gid").agg(F.max("cp").alias("best_cp"), F.bool_or(F.col("cp") % 97 == 0).alias("mate"), F.count_if("agree").alias("n_sound"), ((F.max("p_b") > F.max("p_i")).cast("int") + (F.max("p_a") > 0.1).cast("int")).alias("n_disc"))
    return g.select("gid", D.eligible(F.col("best_cp"), F.col("mate"), F.col("n_sound"), F.col("n_disc"), 500).alias("eligible"))


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS k, o_orderpriority[1:1] AS stratum, CASE WHEN floor(o_totalprice)::BIGINT % 7 = 5 AND o_orderkey % 40 <> 1 THEN 6 ELSE floor(o_totalprice)::BIGINT % 7 END AS bucket FROM orders),
  q AS (SELECT *, row_number() OVER (PARTITION BY stratum, bucket ORDER BY k) AS place FROM r), s AS (SELECT stratum, bucket, count(*) AS n, min(k) AS first FROM q WHERE place <= 30 GROUP BY ALL),
  o AS (SELECT *, CASE bucket WHEN 3 THEN 0 WHEN 5 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS pref FROM s),
  sim AS (SELECT stratum, list(bucket ORDER BY pref, first) AS names, list(n ORDER BY pref, first) AS left_, list(0::BIGINT ORDER BY pref, first) AS used, 0 AS turn, NULL::BIGINT AS bucket, NULL::BIGINT AS place FROM o GROUP BY stratum
    UNION ALL
    SELECT stratum, CASE WHEN left_[i] = used[i] + 1 THEN names[:i - 1] || names[i + 1:] ELSE names END, CASE WHEN left_[i] = used[i] + 1 THEN left_[:i - 1] || left_[i + 1:] ELSE left_ END, CASE WHEN left_[i] = used[i] + 1 THEN used[:i - 1] || used[i + 1:] ELSE used[:i - 1] || [used[i] + 1] || used[i + 1:] END,
      turn + 1, names[i], used[i] + 1 FROM (SELECT *, 1 + turn % len(names) AS i FROM sim WHERE turn < 30 AND len(names) > 0))
  SELECT q.k, sim.stratum, sim.bucket, sim.turn FROM sim JOIN q ON q.stratum = sim.stratum AND q.bucket = sim.bucket AND q.place = sim.place WHERE sim.turn > 0""")
def library_round_robin(spark, sf) -> DataFrame:
    """Thirty of each stratum in turns over its buckets, three of which are preferred; emptied buckets leave the circle."""
    price = F.floor("o_totalprice")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("stratum"), F.when((price % 7 == 5) & (F.col("o_orderkey") % 40 != 1), 6).otherwise(price % 7).alias("bucket"))
    return D.drained_round_robin(rows, "stratum", "bucket", "k", [3, 5, 0], 30).select("k", "stratum", "bucket", "turn")


_INFO = f"""{_R}, i AS (SELECT k, level, CASE WHEN k % 7 <> 0 THEN fen ELSE '' END AS fen, CASE WHEN k % 9 <> 0 THEN move END AS san, CASE WHEN k % 4 <> 0 THEN ['Nf3', 'd4'][1 + k % 2] END AS student, CASE k % 4 WHEN 0 THEN 'opening' WHEN 1 THEN 'endgame' WHEN 2 THEN 'middlegame' ELSE 'unknown' END AS phase, CASE WHEN k % 5 = 0 THEN 'endorse' ELSE 'correct' END AS action FROM r)"""


@query(f"""WITH {_INFO}, o AS (SELECT *, CASE phase WHEN 'endgame' THEN 'activate your king and keep your pieces coordinated' WHEN 'opening' THEN 'develop toward the center and get your king safe' WHEN 'middlegame' THEN 'improve your worst-placed piece and watch your opponent''s ideas' ELSE 'make a purposeful, safe improving move' END AS rule_,
    CASE WHEN action = 'endorse' OR coalesce(student = san, false) THEN san || ' is a sound, level-appropriate choice here.' WHEN student <> san THEN san || ' is a clearer and sounder try than ' || student || '.' ELSE san || ' keeps your position solid and is easy to follow at your level.' END AS lead FROM i WHERE fen <> '' AND san IS NOT NULL)
  SELECT k, 'I''d play ' || san || '. ' || lead || ' Takeaway: When you are unsure, ' || rule_ || '.' AS target, 'Student rating tier: ' || level || ' (' || CASE level WHEN 'beginner' THEN '1000-1200' WHEN 'intermediate' THEN '1300-1600' ELSE '1700-2000' END || ').' || chr(10) || 'FEN: ' || fen AS head,
    CASE WHEN student IS NULL THEN 0 ELSE 1 END AS said FROM o""")
def reformatted_rows(spark, sf) -> DataFrame:
    k = F.col("k")
    info = coached(spark, sf).select("k", "level", F.when(k % 7 != 0, F.col("fen")).otherwise("").alias("fen"), F.when(k % 9 != 0, F.col("move")).alias("san"), F.when(k % 4 != 0, F.when(k % 2 == 0, "Nf3").otherwise("d4")).alias("student"),
                                     F.when(k % 4 == 0, "opening").when(k % 4 == 1, "endgame").when(k % 4 == 2, "middlegame").otherwise("unknown").alias("phase"), F.when(k % 5 == 0, "endorse").otherwise("correct").alias("action"))
    out = T.short_rows(info.withColumn("uci", F.col("san")), B.drawing_of_board(F.col("fen")), F.when(B.fen_field(F.col("fen"), 1) == "w", "White").otherwise("Black"))
    return out.select("k", "target", F.regexp_extract("user", r"(?s)^(.*?\nFEN: [^\n]*)", 1).alias("head"), F.contains("user", F.lit("The student played ")).cast("int").alias("said"))
