"""Queries over sampling, splits, mixes, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import buckets as B
from sievework.operators import incremental as I
from sievework.operators import joins as J
from sievework.operators import mix as X
from sievework.operators import quotas as Q
from sievework.operators import sampling as P
from sievework.plans.fixtures import FACT, POOL, fact, pool
from sievework.plans.registry import query
from sievework.session import table


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


_H = "sha256('0|' || doc_id)"
_FRAC = "('0x' || substr(sha256({}), 1, 8))::BIGINT / 4294967295"


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {_H}, doc_id) AS p FROM documents) WHERE p <= 3")
def stratified_hash_sample(spark, sf) -> DataFrame:
    return P.per_stratum(docs(spark, sf), ["lang", "source"], "doc_id", 3).select("doc_id", "lang", "source")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS p FROM documents) ORDER BY p, lang LIMIT 90")
def round_robin_sample(spark, sf) -> DataFrame:
    return P.round_robin(docs(spark, sf), "lang", "doc_id", 90).select("doc_id", "lang")


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY p, lang) - 1 AS at FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents)")
def interleaved_order(spark, sf) -> DataFrame:
    return P.interleaved(docs(spark, sf), "lang", ["doc_id"]).select("doc_id", "lang", F.col("at").cast("long").alias("at"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) <= (SELECT least(greatest(CAST(round_even(count(*) * 0.05, 0) AS BIGINT), 1), count(*) - 1) FROM documents) AS is_valid FROM documents")
def ratio_split_exact(spark, sf) -> DataFrame:
    return P.ratio_split(docs(spark, sf), "doc_id", 0.05).select("doc_id", "is_valid")


@query("WITH g AS (SELECT l_orderkey AS k, row_number() OVER (ORDER BY sha256('0|' || l_orderkey), l_orderkey) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, p <= (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM g) AS is_valid FROM lineitem JOIN g ON l_orderkey = k")
def group_disjoint_split(spark, sf) -> DataFrame:
    return P.group_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 0.1)


@query(f"SELECT doc_id, p <= CASE WHEN n >= 2 THEN greatest(1, least(round_even(CASE WHEN lang = 'en' THEN .5 ELSE .3 END * n, 0), n - 1)) ELSE round_even(CASE WHEN lang = 'en' THEN .5 ELSE .3 END * n, 0) END AS is_first FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY {_H}, doc_id) AS p FROM documents)")
def stratified_two_way_split(spark, sf) -> DataFrame:
    return P.stratified_split(docs(spark, sf), ["lang", "source"], "doc_id", F.when(F.col("lang") == "en", F.lit(0.5)).otherwise(F.lit(0.3))).select("doc_id", "is_first")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) > 2 AS over FROM documents) ORDER BY over, doc_id LIMIT 200")
def capped_then_filled(spark, sf) -> DataFrame:
    return P.capped_then_filled(docs(spark, sf), ["lang", "source"], "doc_id", 2, 200).select("doc_id")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS p FROM documents) WHERE p <= CASE WHEN lang IN ('fr', 'de') THEN 30 ELSE 18 END")
def priority_sample(spark, sf) -> DataFrame:
    return P.prioritised(docs(spark, sf), ["lang"], "doc_id", F.col("lang").isin("fr", "de"), 30, 18).select("doc_id", "lang")


@query("SELECT least(500, CAST(floor(count(*) * 0.45) AS BIGINT)) AS target FROM documents")
def target_sizing(spark, sf) -> DataFrame:
    return docs(spark, sf).agg(F.least(F.lit(500).cast("long"), F.floor(F.count("*") * 0.45)).alias("target"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 40))")
def first_sorted_ids_subset(spark, sf) -> DataFrame:
    ids = docs(spark, sf).select("doc_id").distinct().orderBy("doc_id").limit(40)
    return docs(spark, sf).join(ids, "doc_id", "left_semi").select("doc_id")


@query(f"WITH {POOL} SELECT gid, idx, cp FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY p_b DESC, idx) AS p FROM pool) WHERE p <= 2")
def top_two_by_policy(spark, sf) -> DataFrame:
    return P.ranked(pool(spark, sf), ["gid"], [F.desc("p_b"), "idx"]).where("place <= 2").select("gid", "idx", "cp")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderdate DESC, o_custkey DESC, o_orderkey) AS p FROM orders) ORDER BY p, o_orderstatus LIMIT 60")
def strongest_first_per_phase(spark, sf) -> DataFrame:
    best = P.ranked(table(spark, sf, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.desc("o_orderdate"), F.desc("o_custkey"), "o_orderkey"]).where("place <= 60")
    return best.orderBy("place", "o_orderstatus").limit(60).select("o_orderkey", "o_orderstatus")


@query(f"WITH {FACT}, p AS (SELECT DISTINCT item, model, level, tokens FROM fact), a AS (SELECT *, row_number() OVER (PARTITION BY level, model ORDER BY tokens DESC, item) AS x FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY x, model) AS q FROM a) SELECT item, model, level FROM b WHERE q <= 100")
def balanced_preference_pairs(spark, sf) -> DataFrame:
    return X.balanced_pairs(fact(spark, sf).select("item", "model", "level", "tokens"), "level", ["model"], "tokens", "item", 300).select("item", "model", "level")


@query(f"SELECT doc_id FROM documents WHERE {_FRAC.format('CAST(doc_id AS VARCHAR)')} < .5")
def hash_downsample(spark, sf) -> DataFrame:
    return docs(spark, sf).where(B.hash_fraction(F.col("doc_id").cast("string")) < 0.5).select("doc_id")


@query("SELECT doc_id, CAST(unnest(range(1, 1 + CASE WHEN lang = 'en' THEN 2 WHEN lang = 'de' THEN 3 ELSE 1 END)) AS INTEGER) AS copy FROM documents")
def replicate_by_class(spark, sf) -> DataFrame:
    return X.replicated(docs(spark, sf), F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 3).otherwise(1)).select("doc_id", "copy")


@query(f"SELECT doc_id, CAST(unnest(range(1, 1 + CAST(floor(w) AS BIGINT) + CASE WHEN {_FRAC.format(chr(39) + '0|' + chr(39) + ' || doc_id')} < w - floor(w) THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 1.5 WHEN lang = 'de' THEN 0.25 ELSE 1.0 END AS w FROM documents)")
def weighted_expand(spark, sf) -> DataFrame:
    return X.weighted_expand(docs(spark, sf), "doc_id", F.when(F.col("lang") == "en", 1.5).when(F.col("lang") == "de", 0.25).otherwise(1.0)).select("doc_id", "copy")


@query("WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) SELECT c_custkey, CAST(unnest(range(1, 2 + CAST(round_even(1.3 * n, 0) AS BIGINT) // n + CASE WHEN p < CAST(round_even(1.3 * n, 0) AS BIGINT) % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r, n")
def cyclic_oversample(spark, sf) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey")
    return X.cyclic_oversample(rows, "c_custkey", 2.3, rows.count()).select("c_custkey", "copy")


@query("WITH g AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS c FROM orders), r AS (SELECT k, row_number() OVER (ORDER BY sha256('0|' || k), k) AS p FROM g WHERE c) SELECT k FROM g WHERE NOT c UNION ALL SELECT k FROM r WHERE p <= (SELECT CAST(floor(0.12 * count(*)) AS BIGINT) FROM g WHERE NOT c)")
def cap_on_a_class(spark, sf) -> DataFrame:
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return X.capped_class(groups, "k", F.col("o_orderstatus") == "F", 0.12).select("k")


@query("SELECT name, drop_same, full_boost, discriminating_boost, drop_collapse, native_only, valid_fraction FROM (VALUES ('v5_iter1', 0.5::DOUBLE, 1, 1, true, false, 0.05::DOUBLE), ('v5_moat', 0.7, 2, 2, true, false, 0.05), ('boost_distinct', 0.85, 3, 2, true, false, 0.05), ('boost_tierfit', 0.5, 2, 3, true, false, 0.05), ('boost_principle', 0.5, 1, 1, true, true, 0.05)) t(name, drop_same, full_boost, discriminating_boost, drop_collapse, native_only, valid_fraction)")
def recipe_table(spark, sf) -> DataFrame:
    return X.recipes(spark)


@query(f"""WITH r AS (SELECT doc_id, source, lang, CASE doc_id % 5 WHEN 0 THEN 'all_same' WHEN 1 THEN 'full' WHEN 2 THEN 'collapse_BA' ELSE 'BI' END AS klass, CASE WHEN doc_id % 2 = 0 THEN 'beginner' ELSE 'intermediate' END AS level, quality = 1 AS disc FROM documents LEFT JOIN labels USING (doc_id)),
  g AS (SELECT source, row_number() OVER (ORDER BY sha256('0|' || source), source) <= greatest(1, CAST(floor(count(*) OVER () * 0.05) AS BIGINT)) AS is_valid FROM (SELECT DISTINCT source FROM documents)),
  k AS (SELECT * FROM r JOIN g USING (source) WHERE NOT (klass = 'collapse_BA' AND level = 'intermediate')),
  d AS (SELECT * FROM k WHERE is_valid OR klass <> 'all_same' OR {_FRAC.format('source')} >= .7)
  SELECT doc_id, is_valid, CAST(unnest(range(1, 1 + CASE WHEN is_valid THEN 1 ELSE 1 + CASE WHEN klass = 'full' THEN 2 ELSE 0 END + CASE WHEN disc THEN 2 ELSE 0 END END)) AS INTEGER) AS copy FROM d""")
def recipe_mix(spark, sf) -> DataFrame:
    m = F.col("doc_id") % 5
    rows = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").withColumn("klass", F.when(m == 0, "all_same").when(m == 1, "full").when(m == 2, "collapse_BA").otherwise("BI"))
    rows = rows.withColumn("level", F.when(F.col("doc_id") % 2 == 0, "beginner").otherwise("intermediate")).withColumn("disc", F.col("quality") == 1).withColumn("native", F.lit(True))
    return X.mixed(rows, X.RECIPES["v5_moat"], "source", "klass", "level", "disc", "native").select("doc_id", "is_valid", "copy")


@query(f"""WITH {FACT}, p AS (SELECT item, level, max(pick) AS pick FROM fact GROUP BY ALL), k AS (SELECT item, count(DISTINCT pick) AS k, min(level) AS f FROM p GROUP BY item) SELECT item, level, pick, k >= 2 AS contrastive FROM p JOIN k USING (item) WHERE k >= 2 OR level = f""")
def contrastive_job_plan(spark, sf) -> DataFrame:
    picks = fact(spark, sf).groupBy("item", "level").agg(F.max("pick").alias("pick"))
    return X.contrastive_plan(picks, "item", "level", "pick").select("item", "level", "pick", "contrastive")


@query(f"""WITH {FACT}, f AS (SELECT item, model, bool_or(sound) AS ok, max(coalesce(grade, 0)) AS g FROM fact GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS p, lead(CASE WHEN ok THEN g END) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY item ORDER BY ok DESC, g DESC, model))
  SELECT item, model, CASE WHEN NOT ok THEN 'salvage' WHEN nxt IS NULL THEN 'sole' WHEN g - nxt <= 1.5 THEN 'judge' ELSE 'score' END AS how FROM r WHERE p = 1""")
def best_of_n(spark, sf) -> DataFrame:
    rows = fact(spark, sf).groupBy("item", "model").agg(F.bool_or("sound").alias("ok"), F.max(F.coalesce("grade", F.lit(0))).alias("g"))
    return X.best_of(rows, ["item"], "ok", "g", "model").select("item", "model", "how")


@query("""WITH r AS (SELECT user_id AS k, event_id, event_type, value, event_type IN ('error', 'view') AS synth FROM events), f AS (SELECT k, min_by(event_type, event_id) AS first_type, min_by(value, (synth::INT, event_id)) AS value FROM r GROUP BY k) SELECT * FROM f""")
def reused_board_collapse(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", "event_type", "value", F.col("event_type").isin("error", "view").cast("int").alias("synth"))
    return X.collapsed_boards(rows.select("k", "event_type", "event_id", "value", "synth"), "k", "event_id", "synth", ["value"]).select("k", F.col("event_type").alias("first_type"), "value")


@query("""WITH u AS (SELECT u.k AS user_id, t.event_type FROM (SELECT DISTINCT user_id AS k FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t) SELECT * FROM u EXCEPT SELECT user_id, event_type FROM events WHERE value > 90""")
def resume_pending_units(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    return J.pending([events.select("user_id").distinct(), events.select("event_type").distinct()], events.where("value > 90"), ["user_id", "event_type"])


@query("""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT user_id, min(n) FILTER (WHERE event_type = 'purchase') AS n, min_by(event_id, n) FILTER (WHERE event_type = 'purchase') AS v, min_by(event_id, n) AS pick, max(n) AS m FROM a WHERE n <= 6 GROUP BY user_id)
  SELECT user_id, coalesce(v, -1) AS event_id, pick, CAST(coalesce(n, m) AS INTEGER) AS attempts, n IS NULL AS fell_back FROM b""")
def first_verified_attempt(spark, sf) -> DataFrame:
    rows = P.ranked(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "n").withColumn("ok", F.col("event_type") == "purchase")
    return I.first_verified(rows, "user_id", "n", "ok", "event_id", 6, F.lit(-1).cast("long"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE value > 10 AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_id < 2000 AND t.user_id = e.user_id AND t.event_type = e.event_type) GROUP BY ALL""")
def idempotent_append(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return I.append_new(events, events.where("event_id < 2000"), ["user_id", "event_type"], F.col("value") > 10, "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, min_by(event_id, event_id) AS first_id FROM events GROUP BY ALL""")
def first_wins_union(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    both = events.where("event_id % 2 = 1").unionByName(events.where("event_id % 2 = 0"))
    return J.first_per_key(both, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"))


@query("""SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def last_wins_union(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return J.last_per_key(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("event_id").alias("last_id"), "value")


@query("""SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS matched FROM documents d""")
def equi_join_skipped(spark, sf) -> DataFrame:
    """Documents, and whether anything was said of them."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("known")).distinct()
    return table(spark, sf, "documents").join(known, F.col("doc_id") == F.col("known"), "left").select("doc_id", F.col("known").isNotNull().alias("matched"))


@query("""SELECT coalesce(s.s_suppkey, o.o_custkey) AS key, s.s_name AS supplier, o.n AS orders FROM supplier s FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON s_suppkey = o_custkey""")
def either_side_lookup(spark, sf) -> DataFrame:
    """Suppliers and counts of orders by one key, of which either side may have none."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("supplier"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
    return s.join(o, "key", "full_outer").select("key", "supplier", "orders")


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, o_orderstatus, 'none') AS target FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def left_join_with_fallback(spark, sf) -> DataFrame:
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"), "c_acctbal")
    return J.with_fallback(table(spark, sf, "orders"), right, ["o_custkey"], "target", F.col("c_acctbal") > 0, F.col("o_orderstatus"), F.lit("none")).select("o_orderkey", "target")


@query("""WITH old AS (SELECT doc_id, quality FROM labels), fresh AS (SELECT doc_id, lang, (n_chars >= 400)::INT AS quality FROM documents WHERE lang IS NOT NULL), j AS (SELECT coalesce(f.lang, 'gone') AS lang, o.doc_id AS o, f.doc_id AS f, o.quality AS was, f.quality AS now FROM old o FULL JOIN fresh f USING (doc_id))
  SELECT lang, count(*) FILTER (WHERE was = now) AS same, count(*) FILTER (WHERE was <> now) AS changed, count(*) FILTER (WHERE o IS NULL) AS new, count(*) FILTER (WHERE f IS NULL) AS gone FROM j GROUP BY lang""")
def old_vs_new_labels(spark, sf) -> DataFrame:
    """Labels made anew joined to the stored ones: the same, changed, only new, only stored."""
    old = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("was"), F.lit(True).alias("o"))
    fresh = table(spark, sf, "documents").where("lang is not null").select("doc_id", "lang", (F.col("n_chars") >= 400).cast("int").alias("now"), F.lit(True).alias("f"))
    return J.compared(old, fresh, "doc_id", "was", "now", F.coalesce("lang", F.lit("gone")), "lang")


@query(f"""WITH {FACT}, a AS (SELECT item, model, row_number() OVER (PARTITION BY item ORDER BY sha256('11|' || item || '|' || model), model) AS p FROM (SELECT DISTINCT item, model FROM fact)) SELECT item, model, chr(CAST(64 + p AS INTEGER)) AS label FROM a""")
def anonymous_labels(spark, sf) -> DataFrame:
    return P.anonymised(fact(spark, sf).select("item", "model").distinct(), "item", "model", 11).select("item", "model", "label")


@query(f"""WITH {FACT}, s AS (SELECT item, min(model) AS first_model, list_sort(list(DISTINCT model)) AS field FROM fact GROUP BY item), e AS (SELECT item, generate_subscripts(field, 1) AS rank, unnest(field) AS model FROM s) SELECT item, CAST(rank AS INTEGER) AS rank, model FROM e""")
def ranking_label_resolution(spark, sf) -> DataFrame:
    items = fact(spark, sf).groupBy("item").agg(F.array_sort(F.collect_set("model")).alias("field"))
    letters = F.transform("field", lambda x, i: F.char(F.lit(65) + i))
    rows = items.select("item", letters.alias("ranking"), F.map_from_arrays(letters, F.col("field")).alias("names"))
    return J.ranked_labels(rows, "ranking", "names").select("item", "rank", F.col("member").alias("model"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x IN ('ring', 'small', 'red', 'widget')) AS tags FROM part), d AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM c WHERE len(tags) > 0),
  s AS (SELECT 0::BIGINT AS n, 20 AS ring, 30 AS small, 25 AS red, 15 AS widget, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS tag
    UNION ALL
    SELECT m, ring - (t = 'ring' AND t IS NOT NULL)::INT, small - (t = 'small' AND t IS NOT NULL)::INT, red - (t = 'red' AND t IS NOT NULL)::INT, widget - (t = 'widget' AND t IS NOT NULL)::INT, pk, t FROM
      (SELECT s.*, d.n AS m, d.p_partkey AS pk, coalesce(list_filter(d.tags, lambda x: CASE x WHEN 'ring' THEN ring > 0 WHEN 'small' THEN small > 0 WHEN 'red' THEN red > 0 ELSE widget > 0 END)[1], '') AS t FROM s JOIN d ON d.n = s.n + 1 WHERE ring + small + red + widget > 0))
  SELECT p_partkey, tag FROM s WHERE tag <> ''""")
def greedy_tag_quota(spark, sf) -> DataFrame:
    """Sequential by nature: each row in order takes the first of its tags that has quota left."""
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return Q.greedy_quota(rows, "tags", "p_partkey", {"ring": 20, "small": 30, "red": 25, "widget": 15})
