"""Queries over banding, selection rules and triads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import buckets as B
from sievework.operators import select as S
from sievework.plans.fixtures import POOL, pool
from sievework.plans.registry import query
from sievework.session import table

RATING = "(p_size * 50 + 300)"


@query(f"""SELECT p_partkey, CASE WHEN {RATING} BETWEEN 1000 AND 1200 THEN 'beginner' WHEN {RATING} BETWEEN 1300 AND 1600 THEN 'intermediate' WHEN {RATING} BETWEEN 1700 AND 2000 THEN 'advanced' END AS band,
  CASE WHEN {RATING} < 1300 THEN 'beginner' WHEN {RATING} < 1700 THEN 'intermediate' ELSE 'advanced' END AS cut FROM part""")
def band_inclusive_with_gaps(spark, sf) -> DataFrame:
    r = F.col("p_size") * 50 + 300
    return table(spark, sf, "part").select("p_partkey", B.level_band(r).alias("band"), B.level_cut(r).alias("cut"))


@query(f"""SELECT coalesce(band, 'none') AS band, count(*) AS n, min(v) AS low, max(v) AS high FROM (SELECT {RATING} AS v,
  CASE WHEN {RATING} >= 600 AND {RATING} < 1000 THEN '600-1000' WHEN {RATING} >= 1000 AND {RATING} < 1300 THEN '1000-1300' WHEN {RATING} >= 1300 AND {RATING} < 1600 THEN '1300-1600'
       WHEN {RATING} >= 1600 AND {RATING} < 1900 THEN '1600-1900' WHEN {RATING} >= 1900 AND {RATING} < 2200 THEN '1900-2200' WHEN {RATING} >= 2200 AND {RATING} < 2600 THEN '2200-2600' END AS band FROM part) GROUP BY 1""")
def band_half_open(spark, sf) -> DataFrame:
    r = F.col("p_size") * 50 + 300
    rows = table(spark, sf, "part").select(r.alias("v"), F.coalesce(B.range_label(r), F.lit("none")).alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query(f"""SELECT c AS centre, count(*) AS n FROM (SELECT CASE WHEN v BETWEEN 700 AND 900 THEN 800 WHEN v BETWEEN 1100 AND 1300 THEN 1200 WHEN v BETWEEN 1500 AND 1700 THEN 1600
  WHEN v BETWEEN 1900 AND 2100 THEN 2000 WHEN v BETWEEN 2300 AND 2500 THEN 2400 END AS c FROM (SELECT {RATING} AS v FROM part)) WHERE c IS NOT NULL GROUP BY 1""")
def window_bucket_counts(spark, sf) -> DataFrame:
    rows = table(spark, sf, "part").select(B.window_bucket(F.col("p_size") * 50 + 300).alias("centre")).where("centre IS NOT NULL")
    return rows.groupBy("centre").agg(F.count("*").alias("n"))


@query(f"""WITH {POOL} SELECT gid, idx, greatest(0, best - cp) AS loss, CASE WHEN greatest(0, best - cp) < 50 THEN 'none' WHEN greatest(0, best - cp) < 100 THEN 'inaccuracy' WHEN greatest(0, best - cp) < 250 THEN 'mistake' ELSE 'blunder' END AS severity
  FROM (SELECT *, max(cp) OVER (PARTITION BY gid) AS best FROM pool)""")
def severity_of_loss(spark, sf) -> DataFrame:
    rows = pool(spark, sf).withColumn("best", F.max("cp").over(Window.partitionBy("gid")))
    return rows.select("gid", "idx", B.clamped_loss(F.col("best"), F.col("cp")).alias("loss")).withColumn("severity", B.severity(F.col("loss")))


@query(f"""WITH {POOL}, bins(bin) AS (VALUES ('>=.50'), ('.25-.50'), ('.10-.25'), ('.05-.10'), ('<.05')),
  h AS (SELECT CASE WHEN p_a >= .5 THEN '>=.50' WHEN p_a >= .25 THEN '.25-.50' WHEN p_a >= .10 THEN '.10-.25' WHEN p_a >= .05 THEN '.05-.10' ELSE '<.05' END AS bin, count(*) AS n FROM pool GROUP BY 1)
  SELECT bin, coalesce(n, 0) AS n FROM bins LEFT JOIN h USING (bin)""")
def policy_histogram(spark, sf) -> DataFrame:
    counts = pool(spark, sf).groupBy(B.policy_bin(F.col("p_a")).alias("bin")).agg(F.count("*").alias("n"))
    return S.zero_filled(counts, "bin", B.POLICY_BINS, "n")


@query(f"""WITH {POOL}, r AS (SELECT gid, idx, row_number() OVER (PARTITION BY gid ORDER BY p_b DESC, idx) - 1 AS rank FROM pool)
  SELECT CASE WHEN rank <= 0 THEN 'best' WHEN rank <= 2 THEN 'near' WHEN rank <= 5 THEN 'mid' ELSE 'tail' END AS bucket, count(*) AS n FROM r GROUP BY 1""")
def rank_buckets(spark, sf) -> DataFrame:
    ranked = S.pool_rank(pool(spark, sf), "gid", "p_b", "idx")
    return ranked.groupBy(B.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count("*").alias("n"))


_BLEND = """b AS (SELECT gid, idx, cp, {p} AS p, max(cp) OVER w AS hi, min(cp) OVER w AS lo, max({p}) OVER w AS ph, min({p}) OVER w AS pl FROM pool WINDOW w AS (PARTITION BY gid)),
  s AS (SELECT gid, idx, cp, round((1 - {w}) * CASE WHEN hi = lo THEN 1.0 ELSE (cp - lo) / (hi - lo) END + {w} * CASE WHEN ph = pl THEN 1.0 ELSE (p - pl) / (ph - pl) END, 4) AS score FROM b)"""


@query(f"WITH {POOL}, {_BLEND.format(p='p_i', w='0.5::DOUBLE')} SELECT gid, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, cp DESC, idx) AS r FROM s) WHERE r = 1")
def blend_argmax_pick(spark, sf) -> DataFrame:
    return S.blended_pick(pool(spark, sf), "gid", "cp", "p_i", "idx", 0.5).select("gid", "idx", "score")


@query(f"WITH {POOL} SELECT gid, idx, (cp - lo) / (hi - lo) AS norm FROM (SELECT gid, idx, cp, max(cp) OVER (PARTITION BY gid) AS hi, min(cp) OVER (PARTITION BY gid) AS lo FROM pool) WHERE hi > lo UNION ALL SELECT gid, idx, 1.0 FROM (SELECT gid, idx, max(cp) OVER (PARTITION BY gid) AS hi, min(cp) OVER (PARTITION BY gid) AS lo FROM pool) WHERE hi = lo")
def min_max_normalised(spark, sf) -> DataFrame:
    w = Window.partitionBy("gid")
    return pool(spark, sf).select("gid", "idx", S.normalised(F.col("cp"), w).alias("norm"))


@query(f"""WITH {POOL} SELECT gid, count(*) AS kept, max(cp) AS best, min(cp) AS least FROM (SELECT *, max(cp) OVER (PARTITION BY gid) AS best FROM pool) WHERE best - cp <= 150 GROUP BY gid""")
def pool_within_tolerance(spark, sf) -> DataFrame:
    kept = S.sound_pool(pool(spark, sf), "gid", "cp")
    return kept.groupBy("gid").agg(F.count("*").alias("kept"), F.max("cp").alias("best"), F.min("cp").alias("least"))


_TRIAD = """ranked AS (SELECT *, best - cp AS gap, (CASE WHEN agree THEN 2 ELSE 0 END) + (CASE WHEN best - cp < 40 THEN 1 ELSE 0 END) - CAST(floor(greatest(0, best - cp) / 40.0) AS BIGINT) AS robust FROM (SELECT *, max(cp) OVER (PARTITION BY gid) AS best FROM pool)),
  top AS (SELECT gid, arg_max(idx, (cp, -idx)) AS a FROM ranked GROUP BY gid),
  bpick AS (SELECT gid, arg_max(idx, (robust, p_b, cp, -idx)) AS b FROM ranked WHERE p_b >= 0.10 GROUP BY gid),
  ipick AS (SELECT gid, arg_max(idx, (robust, p_i, cp, -idx)) AS i FROM ranked WHERE p_i >= 0.05 GROUP BY gid),
  picks AS (SELECT gid, coalesce(b, a) AS b, coalesce(i, a) AS i0, a, b IS NULL AS fallback FROM top LEFT JOIN bpick USING (gid) LEFT JOIN ipick USING (gid)),
  fixed AS (SELECT gid, b, CASE WHEN b = a AND i0 <> b THEN b ELSE i0 END AS i, a, fallback FROM picks)"""


@query(f"""WITH {POOL}, {_TRIAD} SELECT gid, b, i, a, fallback, b <> a AS discriminating, CASE WHEN b = i AND i = a THEN 'B=I=A' WHEN b = i THEN 'B=I!=A' WHEN i = a THEN 'I=A!=B' WHEN b = a THEN 'B=A!=I' ELSE 'B!=I!=A' END AS pattern FROM fixed""")
def triad_selection(spark, sf) -> DataFrame:
    return S.triads(pool(spark, sf)).select("gid", "b", "i", "a", "fallback", "discriminating", "pattern")


@query(f"""WITH {POOL}, {_TRIAD}, c AS (SELECT CASE WHEN b = i AND i = a THEN 'all_same' WHEN b = a THEN 'collapse_BA' WHEN b = i THEN 'BI' WHEN i = a THEN 'IA' ELSE 'full' END AS class FROM fixed) SELECT class, count(*) AS n FROM c GROUP BY 1""")
def triad_pattern(spark, sf) -> DataFrame:
    rows = S.triads(pool(spark, sf))
    return rows.groupBy(B.triad_class(F.col("b"), F.col("i"), F.col("a")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {POOL}, w AS (SELECT gid, idx, cp, [cp % 500, 300, (cp * 7) % 500] AS wdl FROM pool),
  e AS (SELECT gid, idx, (wdl[1] + wdl[2] / 2) / (wdl[1] + wdl[2] + wdl[3]) AS expected FROM w)
  SELECT gid, idx, round(expected, 6) AS expected, CASE WHEN expected >= .75 THEN 'win' WHEN expected <= .25 THEN 'loss' ELSE 'draw' END AS band FROM e""")
def expected_score_bands(spark, sf) -> DataFrame:
    wdl = F.array(F.col("cp") % 500, F.lit(300).cast("long"), (F.col("cp") * 7) % 500)
    rows = pool(spark, sf).select("gid", "idx", B.expected_score(wdl).alias("e"))
    return rows.select("gid", "idx", F.round("e", 6).alias("expected"), B.outcome_band(F.col("e")).alias("band"))


@query(f"""WITH {POOL}, r AS (SELECT gid, idx, cp, max(cp) OVER (PARTITION BY gid) - cp AS loss, idx <= 5 AS inside, idx = 7 AS drops FROM pool)
  SELECT CASE WHEN drops OR loss > 90 THEN 'correct' WHEN loss <= 30 AND inside THEN 'endorse' WHEN inside THEN 'soft' ELSE 'correct' END AS action, count(*) AS n FROM r GROUP BY 1""")
def review_actions(spark, sf) -> DataFrame:
    rows = pool(spark, sf).withColumn("loss", F.max("cp").over(Window.partitionBy("gid")) - F.col("cp"))
    action = B.review_action(F.lit(True), F.col("idx") == 7, F.col("loss"), F.col("idx") <= 5)
    return rows.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(f"""WITH {POOL}, r AS (SELECT gid, idx, CASE WHEN max(cp) OVER w - cp > 150 THEN 'cp_d2' WHEN NOT agree THEN 'shallow_only' WHEN p_b > 0.09 THEN 'wdl_drop' END AS reason, row_number() OVER (PARTITION BY gid ORDER BY cp DESC, idx) AS place FROM pool WINDOW w AS (PARTITION BY gid))
  SELECT gid, idx, CASE WHEN place = 1 THEN NULL ELSE reason END AS reason FROM r""")
def deep_pool_reasons(spark, sf) -> DataFrame:
    rows = pool(spark, sf).withColumn("best", F.max("cp").over(Window.partitionBy("gid")))
    return S.first_failing(rows, "gid", "cp", "idx", [("cp_d2", F.col("best") - F.col("cp") > 150), ("shallow_only", ~F.col("agree")), ("wdl_drop", F.col("p_b") > 0.09)]).select("gid", "idx", "reason")


@query("""SELECT p_partkey, coalesce(list_filter(['ring', 'widget', 'bolt'], lambda x: list_contains(t, x))[1], list_filter(t, lambda x: x NOT IN ('small', 'red'))[1], 'other') AS tag FROM (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)""")
def priority_first_tag(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", B.first_by_priority(F.split("p_name", " "), ["ring", "widget", "bolt"], ["small", "red"]).alias("tag"))


@query("""SELECT doc_id, CASE WHEN span <= 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(k), lambda j: CAST(least(floor(4 + span / k * (j + 0.5)), n - 3) AS BIGINT)))) END AS places
  FROM (SELECT doc_id, n, n - 6 AS span, least(5, n - 6) AS k FROM (SELECT doc_id, n_chars % 40 AS n FROM documents)) WHERE span > 0""")
def even_middle_places(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 40).cast("int").alias("n")).where("n > 6")
    return rows.select("doc_id", B.even_places(F.col("n"), 4, 2, 5).cast("array<bigint>").alias("places"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN base ELSE regexp_replace(base, '_[^_]*$', '') END AS game FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'puz_' || doc_id || '_x' ELSE 'g' || (doc_id // 4) || '_' || (doc_id % 4) END AS base FROM documents)""")
def group_from_composite_id(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    base = F.when(d % 3 == 0, F.concat(F.lit("puz_"), d, F.lit("_x"))).otherwise(F.concat(F.lit("g"), F.floor(d / 4), F.lit("_"), d % 4))
    return table(spark, sf, "documents").select("doc_id", B.group_of_id(F.concat(base, F.lit("#"), F.col("lang"))).alias("game"))


@query(f"""WITH {POOL}, {_TRIAD}, w AS (SELECT f.gid, f.b <> f.a AS discriminating, (SELECT max(p_b) FROM pool p WHERE p.gid = f.gid AND p.idx = f.b) AS pb, (SELECT max(p_b) FROM pool p WHERE p.gid = f.gid AND p.idx = f.a) AS pa FROM fixed f)
  SELECT gid, CASE WHEN discriminating AND pb >= .10 AND round(pb - pa, 6) >= .05 THEN 1.5 WHEN discriminating THEN 1.0 ELSE 0.25 END::DOUBLE AS weight FROM w""")
def sampling_weights(spark, sf) -> DataFrame:
    return S.confident(S.triads(pool(spark, sf)), pool(spark, sf)).select("gid", B.sampling_weight(F.col("high_confidence"), F.col("discriminating")).alias("weight"))


@query(f"""WITH {POOL} SELECT gid, level, CASE level WHEN 'beginner' THEN b WHEN 'intermediate' THEN i ELSE a END AS policy, gid || '#' || level AS scenario FROM (SELECT gid, max(p_b) AS b, max(p_i) AS i, max(p_a) AS a FROM pool GROUP BY gid), (VALUES ('beginner'), ('intermediate'), ('advanced')) t(level)""")
def scenario_flatten(spark, sf) -> DataFrame:
    tops = pool(spark, sf).groupBy("gid").agg(F.max("p_b").alias("beginner"), F.max("p_i").alias("intermediate"), F.max("p_a").alias("advanced"))
    return S.scenarios(tops, "gid", "policy")
