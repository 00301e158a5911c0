"""Queries of operators whose shuffle does not grow with what they leave alone: exclusion, patterns, identity, quotas, intervals, councils."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import council as C
from sievework.operators import exclusion, identity, patterns, quotas
from sievework.operators import metrics as M
from sievework.plans.registry import query
from sievework.session import spread, table


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal < 0)
  AND l.l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 45)""")
def chained_group_exclusion(spark, sf) -> DataFrame:
    """Lines without those of indebted suppliers, urgent orders, or very large parts."""
    held = {
        "l_suppkey": table(spark, sf, "supplier").where("s_acctbal < 0").select("s_suppkey"),
        "l_orderkey": table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey"),
        "l_partkey": table(spark, sf, "part").where("p_size > 45").select("p_partkey"),
    }
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return exclusion.chained_anti(lines, held).select("l_orderkey", "l_linenumber")


_PATTERNS = r"""p AS (SELECT 'item' || (item_id % 7) AS family, item_id AS priority, '(?i)(^|[^\p{L}\p{N}])' || w[1] || '[ \n\t]+' || w[2] || '($|[^\p{L}\p{N}])' AS pattern
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) > 1)"""


@query(rf"""WITH {_PATTERNS}, hit AS (SELECT doc_id, min_by(family, (priority, family, pattern)) AS family FROM documents JOIN p ON regexp_matches(text, pattern) GROUP BY doc_id)
  SELECT doc_id, coalesce(hit.family, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'other' END) AS family FROM documents LEFT JOIN hit USING (doc_id)""")
def pattern_table_families(spark, sf) -> DataFrame:
    """The first of the patterns made of each benchmark passage's first two words that a document matches; else what a
    substring says; else a default."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    known = table(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 1)
    known = known.select(F.concat(F.lit("item"), F.col("item_id") % 7).alias("family"), F.col("item_id").alias("priority"), F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}])"), F.col("w")[0], F.lit(r"[ \n\t]+"), F.col("w")[1], F.lit(r"($|[^\p{L}\p{N}])")).alias("pattern"), F.array(F.lower(F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1]))).alias("starts"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return patterns.first_family(docs, "doc_id", "text", known, [("license", "legal"), ("@", "contact")], "other", pairs=True).select("doc_id", "family")


_SIDES = """a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders),
  b AS (SELECT k, CASE WHEN k % 101 = 3 THEN NULL ELSE c END AS c, s FROM a WHERE k % 97 <> 5 UNION ALL SELECT * FROM a WHERE k % 89 = 7 AND k % 97 <> 5 AND k % 101 <> 3 UNION ALL SELECT -1 - k, c, s FROM a WHERE k % 83 = 2)"""


@query(f"""WITH {_SIDES}, x AS (SELECT k, count(*) AS n, list_sort(list(DISTINCT (c, s))) AS kinds, list_sort(list((c, s))) AS every FROM a GROUP BY k), y AS (SELECT k, count(*) AS n, list_sort(list(DISTINCT (c, s))) AS kinds, list_sort(list((c, s))) AS every FROM b GROUP BY k)
  SELECT k, CASE WHEN y.n IS NULL THEN 'missing' WHEN x.n IS NULL THEN 'extra' WHEN x.kinds = y.kinds THEN 'repeated' ELSE 'changed' END AS kind, coalesce(x.n, 0) AS left_n, coalesce(y.n, 0) AS right_n
  FROM x FULL JOIN y USING (k) WHERE x.every IS DISTINCT FROM y.every""")
def table_identity(spark, sf) -> DataFrame:
    """Orders against a copy in which some are missing, some are new, some are there twice and some lost their customer."""
    k = F.col("k")
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    b = a.where(k % 97 != 5).withColumn("c", F.when(k % 101 != 3, F.col("c")))
    b = b.unionByName(a.where((k % 89 == 7) & (k % 97 != 5) & (k % 101 != 3))).unionByName(a.where(k % 83 == 2).withColumn("k", -1 - k))
    return identity.differing_keys(a, b, ["k"], ["c", "s"])


#: Quotas of three tags; the last two are filled at every size, the first at none of the small ones.
_QUOTAS = {"R": 100_000, "N": 1500, "BIG": 700}


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS o, list_filter([l_returnflag, CASE WHEN l_quantity > 10 THEN 'BIG' END, CASE WHEN l_linestatus = 'O' THEN 'N' END], lambda t: t IN ('R', 'N', 'BIG')) AS tags FROM lineitem),
  q AS (SELECT * FROM (VALUES ('R', 100000), ('N', 1500), ('BIG', 700)) v(tag, quota)),
  r1 AS (SELECT o, tags, tags[1] AS tag FROM r), c1 AS (SELECT tag, max(o) FILTER (WHERE n <= quota) AS cut, max(n) > any_value(quota) AS full_ FROM (SELECT tag, o, row_number() OVER (PARTITION BY tag ORDER BY o) AS n FROM r1 WHERE tag IS NOT NULL) JOIN q USING (tag) GROUP BY tag),
  m1 AS (SELECT coalesce(map_from_entries(list((tag, cut)) FILTER (WHERE full_)), MAP {}) AS m FROM c1),
  r2 AS (SELECT o, tags, list_filter(tags, lambda t: o <= coalesce(m[t], 9223372036854775807))[1] AS tag FROM r, m1), c2 AS (SELECT tag, max(o) FILTER (WHERE n <= quota) AS cut, max(n) > any_value(quota) AS full_ FROM (SELECT tag, o, row_number() OVER (PARTITION BY tag ORDER BY o) AS n FROM r2 WHERE tag IS NOT NULL) JOIN q USING (tag) GROUP BY tag),
  m2 AS (SELECT map_concat((SELECT m FROM m1), coalesce(map_from_entries(list((tag, cut)) FILTER (WHERE full_)), MAP {})) AS m FROM c2),
  r3 AS (SELECT o, tags, list_filter(tags, lambda t: o <= coalesce(m[t], 9223372036854775807))[1] AS tag FROM r, m2), c3 AS (SELECT tag, max(o) FILTER (WHERE n <= quota) AS cut, max(n) > any_value(quota) AS full_ FROM (SELECT tag, o, row_number() OVER (PARTITION BY tag ORDER BY o) AS n FROM r3 WHERE tag IS NOT NULL) JOIN q USING (tag) GROUP BY tag),
  m3 AS (SELECT map_concat((SELECT m FROM m2), coalesce(map_from_entries(list((tag, cut)) FILTER (WHERE full_)), MAP {})) AS m FROM c3)
  SELECT o, list_filter(tags, lambda t: o <= coalesce(m[t], 9223372036854775807))[1] AS tag FROM r, m3 WHERE tag IS NOT NULL""")
def large_tag_quotas(spark, sf) -> DataFrame:
    """Lines take the first of their tags that has quota left, in order of their keys; quotas up to a hundred thousand."""
    tags = F.array("l_returnflag", F.when(F.col("l_quantity") > 10, "BIG"), F.when(F.col("l_linestatus") == "O", "N"))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), tags.alias("tags"))
    return quotas.greedy_quota(rows, "tags", "o", _QUOTAS)


_DRAWS = """cuts AS (SELECT list_transform(range(13), lambda k: floor(4294967296 * exp(-1) * list_sum(list_transform(range(k + 1), lambda j: 1.0::DOUBLE / factorial(j::INT)::DOUBLE)))) AS t),
  i AS (SELECT coalesce(o_custkey::VARCHAR, '') AS item, sum(o_totalprice) AS s, count(o_totalprice) AS c FROM orders GROUP BY 1),
  h AS (SELECT item, s, c, j, sha256('11|' || j || '|' || item) AS x FROM i, range(25) g(j)),
  w AS (SELECT j * 8 + e AS b, s, c, len(list_filter(t, lambda k: ('0x' || substr(x, 1 + 8 * e::INT, 8))::BIGINT >= k)) AS w FROM h, cuts, range(8) y(e)),
  m AS (SELECT sum(w * s) / sum(w * c) AS m FROM w GROUP BY b), z AS (SELECT list_sort(list(m)) AS a FROM m)"""


@query(f"""WITH {_DRAWS} SELECT 'last' AS rule, round(a[1 + floor(0.025 * 199)::INT], 2) AS low, round(a[1 + floor(0.975 * 199)::INT], 2) AS high FROM z
  UNION ALL SELECT 'count', round(a[1 + floor(0.025 * 200)::INT], 2), round(a[1 + floor(0.975 * 200)::INT], 2) FROM z""")
def bootstrap_ci_one_pass(spark, sf) -> DataFrame:
    """Intervals of the mean price over all orders, drawn by customers, with both rules of placing a percentile."""
    orders = table(spark, sf, "orders")
    of = lambda rule: M.poisson_bootstrap(orders, "o_custkey", "o_totalprice", 200, 11, rule).select(F.lit(rule).alias("rule"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))
    return of("last").unionByName(of("count"))


_FLAT = """l AS (SELECT *, row_number() OVER () AS id FROM lineitem),
  f AS (SELECT id, l_linenumber % 3 AS judge, l_returnflag AS condition, i, (i + l_orderkey) % 5 AS member, l_partkey, l_suppkey, l_quantity, l_linenumber,
    NOT (l_partkey % 6 = 0 AND i = l_suppkey % 5) AS ranked, (i * 7 + l_partkey) % 5 AS turn FROM l, range(5) g(i)),
  r AS (SELECT condition, judge, member, i, CASE WHEN ranked THEN row_number() OVER (PARTITION BY id, ranked ORDER BY turn, i) END AS rank,
    CASE WHEN (l_suppkey + i) % 4 <> 0 THEN (l_suppkey + i) % 5 + 1 END AS clarity, CASE WHEN (floor(l_quantity)::BIGINT + i) % 3 <> 0 THEN (floor(l_quantity)::BIGINT + i) % 5 + 1 END AS correctness FROM f)"""


@query(f"""WITH {_FLAT}, g AS (SELECT CASE grouping(condition, judge, member) WHEN 2 THEN 'members' WHEN 0 THEN 'judges' WHEN 4 THEN 'pooled' ELSE 'items' END AS grid, condition, judge, member, count(rank) AS n, avg(rank) AS mr, avg((rank = 1)::INT) AS wr, count(clarity) AS n_clarity, avg(clarity) AS mc, count(correctness) AS n_correctness, avg(correctness) AS mo, count(*) FILTER (WHERE i = 0) AS items
  FROM r GROUP BY GROUPING SETS ((condition, member), (condition, judge, member), (judge, member), (condition)))
  SELECT grid, condition, judge, member, CASE WHEN grid <> 'items' THEN n END AS n, CASE WHEN grid <> 'items' THEN round(mr, 6) END AS mean_rank, CASE WHEN grid <> 'items' THEN round(wr, 6) END AS win_rate, CASE WHEN grid <> 'items' THEN n_clarity END AS n_clarity, CASE WHEN grid <> 'items' THEN round(mc, 6) END AS mean_clarity,
    CASE WHEN grid <> 'items' THEN n_correctness END AS n_correctness, CASE WHEN grid <> 'items' THEN round(mo, 6) END AS mean_correctness, CASE WHEN grid = 'items' THEN items END AS items FROM g""")
def council_grids(spark, sf) -> DataFrame:
    """Each line is a judge's row on five labelled members: mean ranks, first places and scores, for all, by judge, and pooled."""
    five = F.sequence(F.lit(0), F.lit(4))
    letter = lambda i: F.char(F.lit(65) + i)
    ranked = F.filter(five, lambda i: ~((F.col("l_partkey") % 6 == 0) & (i == F.col("l_suppkey") % 5)))
    turns = F.array_sort(F.transform(ranked, lambda i: F.struct(((i * 7 + F.col("l_partkey")) % 5).alias("turn"), i.alias("i"))))
    score = lambda base, skip: lambda i: F.when((base + i) % skip != 0, ((base + i) % 5 + 1).cast("int"))
    clarity, correctness = score(F.col("l_suppkey"), 4), score(F.floor("l_quantity"), 3)
    scores = F.map_from_entries(F.transform(five, lambda i: F.struct(letter(i), F.create_map(F.lit("clarity"), clarity(i), F.lit("correctness"), correctness(i)))))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("condition"), (F.col("l_linenumber") % 3).cast("long").alias("judge"), F.transform(turns, lambda x: letter(x["i"])).alias("ranking"),
        F.map_from_entries(F.transform(five, lambda i: F.struct(letter(i), ((i + F.col("l_orderkey")) % 5).cast("long")))).alias("names"), scores.alias("scores"),
    )
    out = C.council(rows, ["clarity", "correctness"])
    return out.select("grid", "condition", "judge", "member", "n", F.round("mean_rank", 6).alias("mean_rank"), F.round("win_rate", 6).alias("win_rate"), "n_clarity", F.round("mean_clarity", 6).alias("mean_clarity"), "n_correctness", F.round("mean_correctness", 6).alias("mean_correctness"), "items")


_TOLD = """t AS (SELECT source AS model, doc_id % 7 = 0 AND source = (SELECT min(source) FROM documents) AS ungated, CASE WHEN doc_id % 5 <> 0 THEN 1 + doc_id % 4 END AS attempts, doc_id % 9 = 0 AS fallback, text, contains(text, '.') AS formed, n_chars % 3 <> 0 AS sound, n_chars % 4 = 0 AS fabricated FROM documents)"""


def _told(spark, sf) -> DataFrame:
    d, n, docs = F.col("doc_id"), F.col("n_chars"), table(spark, sf, "documents")
    first = docs.agg(F.min("source")).scalar()
    return docs.select(F.col("source").alias("model"), ((d % 7 == 0) & (F.col("source") == first)).alias("ungated"), F.when(d % 5 != 0, 1 + d % 4).alias("attempts"), (d % 9 == 0).alias("fallback"), (~F.col("text").rlike(T.LEAKS_AUDIT)).alias("clean"), F.contains("text", F.lit(".")).alias("formed"), (n % 3 != 0).alias("sound"), (n % 4 == 0).alias("fabricated"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""WITH {_TOLD}, k AS (SELECT model, coalesce(ungated, false) AS raw, count(*) AS n, round(avg(coalesce(attempts, 1)), 3) AS ma, round(avg(fallback::INT), 4) AS fb, round(avg((NOT regexp_matches(text, '{_q(T.LEAKS_AUDIT)}'))::INT), 4) AS clean_rate, round(avg(formed::INT), 4) AS formed_rate, round(avg(sound::INT), 4) AS sr, round(avg((NOT fabricated)::INT), 4) AS fr FROM t GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY raw DESC) AS p FROM k)
  SELECT model, NOT raw AS gated, n, CASE WHEN NOT raw THEN ma END AS mean_attempts, CASE WHEN NOT raw THEN fb END AS fallback_rate, clean_rate, formed_rate, CASE WHEN raw THEN sr END AS sound_rate, CASE WHEN raw THEN fr END AS first_draft_rate FROM o WHERE p = 1""")
def gate_telemetry(spark, sf) -> DataFrame:
    """Documents as a model's answers, their sources as models, of which one has answers that no gate saw."""
    return C.telemetry(_told(spark, sf), "model")


@query("""WITH x AS (SELECT role AS model, length(coalesce(text, '')) % 3 = 0 AS raw, length(coalesce(text, '')) % 9 = 0 AND turn > 0 AS gated, turn % 2 = 1 AND length(coalesce(text, '')) % 3 = 0 AS fb, turn + 1 AS attempts FROM conversations)
  SELECT model, count(*) AS n, round(avg(raw::INT), 4) AS raw_rate, round(avg(gated::INT), 4) AS gated_rate, round(round(avg(gated::INT), 4) - round(avg(raw::INT), 4), 4) AS delta, round(avg(fb::INT), 4) AS fallback_rate, round(avg(attempts), 4) AS mean_attempts,
    count(*) FILTER (WHERE raw) AS fabricated, count(*) FILTER (WHERE raw AND NOT fb) AS by_model, count(*) FILTER (WHERE raw AND fb) AS by_fallback, count(*) FILTER (WHERE raw AND gated) AS still FROM x GROUP BY model""")
def gate_resolution(spark, sf) -> DataFrame:
    """Turns as answers: what became of those whose first draft was made up."""
    size = F.length(F.coalesce("text", F.lit("")))
    rows = table(spark, sf, "conversations").select(F.col("role").alias("model"), (size % 3 == 0).alias("raw_fabricated"), ((size % 9 == 0) & (F.col("turn") > 0)).alias("gated_fabricated"), ((F.col("turn") % 2 == 1) & (size % 3 == 0)).alias("fallback"), (F.col("turn") + 1).alias("attempts"))
    return C.resolution(rows, "model")
