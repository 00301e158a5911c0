"""Queries over gates, dedup, decontamination and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import structs as K
from sievework.functions import text as T
from sievework.operators import gates as G
from sievework.operators import joins as J
from sievework.plans.registry import query
from sievework.session import spread, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blanks that both dialects know alike.
BLANKS = r"[\t\n\x0B\f\r ]+"


def low(text: F.Column) -> F.Column:
    """A-Z lower-cased; lower() does the same, faster, where there are only ASCII characters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lowered(text: F.Column) -> F.Column:
    """Blanks squeezed, A-Z lower-cased."""
    return low(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")))


def gated(spark, sf) -> DataFrame:
    """Documents with the reasons of a gate stack on their whole texts, and a digest of the squeezed, lowered text as key."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " "))
    rows = docs.select("doc_id", "lang", "source", body.alias("body")).withColumn("low", low(F.col("body"))).withColumn("key", F.md5("low"))
    held = lambda part: F.floor((F.length("body") - F.length(F.replace("body", F.lit(part), F.lit("")))) / len(part))
    words = ("stupid", "trash", "idiot", "moron")
    named = F.contains("low", F.lit(words[0])) | F.contains("low", F.lit(words[1])) | F.contains("low", F.lit(words[2])) | F.contains("low", F.lit(words[3]))  # cheap, so that few texts are matched
    symbols = F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]+", ""))
    return G.with_reasons(rows, [("too_short", held(" ") + 1 < 30), ("symbols", symbols * 20 > F.length("body")), ("shouting", F.length(F.regexp_replace("body", "[^A-Z]+", "")) * 2 > F.length("body")),
                                 ("table", held(" | ") + 1 > 10), ("abuse", named & F.col("low").rlike(rf"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"))])


_LOWERED = r"translate(trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GATED = rf"""g0 AS (SELECT doc_id, lang, source, trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') AS body, {_LOWERED} AS key FROM documents),
  g1 AS (SELECT *, len(string_split(body, ' ')) AS words FROM g0),
  gated AS (SELECT *, list_filter([CASE WHEN words < 30 THEN 'too_short' END, CASE WHEN (length(body) - length(translate(body, '#*$%&|<>', ''))) * 20 > length(body) THEN 'symbols' END,
    CASE WHEN length(regexp_replace(body, '[^A-Z]', '', 'g')) * 2 > length(body) THEN 'shouting' END, CASE WHEN len(string_split(body, ' | ')) > 10 THEN 'table' END,
    CASE WHEN regexp_matches(key, '(^|[^a-z])(stupid|trash|idiot|moron)([^a-z]|$)') THEN 'abuse' END], lambda x: x IS NOT NULL) AS reasons FROM g1)"""
_HELD = f"held AS (SELECT DISTINCT {_LOWERED} AS key FROM benchmark)"
_CLEAN = """clean AS (SELECT *, CASE WHEN len(reasons) = 0 AND row_number() OVER (PARTITION BY key, len(reasons) = 0 ORDER BY doc_id) > 1 THEN ['duplicate'] ELSE reasons END AS why FROM gated)"""


def held_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.md5(lowered(F.col("text"))).alias("key")).distinct()


@query(f"""WITH {_GATED}, {_CLEAN}, {_HELD}, left_ AS (SELECT c.* FROM clean c ANTI JOIN held USING (key)),
  e AS (SELECT lang, unnest(CASE WHEN len(why) = 0 THEN ['kept'] ELSE why END) AS reason FROM left_)
  SELECT coalesce(lang, 'ALL') AS lang, reason, count(*) AS n FROM e GROUP BY GROUPING SETS ((lang, reason), (reason))""")
def flagship_gate_report(spark, sf) -> DataFrame:
    """Gate stack, first clean copy, held-out anti join, then reasons by language and overall."""
    clean = G.first_clean(gated(spark, sf), ["key"], ["doc_id"])
    rest = J.held_out(clean, held_keys(spark, sf), "key")
    each = rest.select("lang", F.explode(F.when(F.col("kept"), F.array(F.lit("kept"))).otherwise(F.col("reasons"))).alias("reason"))
    return each.groupingSets([["lang", "reason"], ["reason"]], "lang", "reason").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "reason", "n")


@query(f"WITH {_GATED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM gated) GROUP BY reason")
def gate_reason_histogram(spark, sf) -> DataFrame:
    return G.reason_histogram(gated(spark, sf))


@query(f"WITH {_GATED}, {_CLEAN} SELECT doc_id, array_to_string(why, ',') AS reasons, len(why) = 0 AS kept FROM clean")
def first_clean_copy(spark, sf) -> DataFrame:
    out = G.first_clean(gated(spark, sf), ["key"], ["doc_id"])
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "kept")


@query("""WITH r AS (SELECT doc_id, source, lang, n_chars % 7 AS move FROM documents) SELECT lang, count(*) FILTER (WHERE a = 1) AS by_board_move, count(*) FILTER (WHERE b = 1) AS by_all
  FROM (SELECT *, row_number() OVER (PARTITION BY source, move ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source, lang, move ORDER BY doc_id) AS b FROM r) GROUP BY lang""")
def configurable_dedup_key(spark, sf) -> DataFrame:
    """How many documents of each language are the first of their key, by both keys; minima merge, so no key needs one task."""
    rows = table(spark, sf, "documents").withColumn("move", F.col("n_chars") % 7)
    first = lambda mode: rows.groupBy(*G.dedup_key(mode, "source", "lang", "move")).agg(F.min_by(F.struct("lang"), "doc_id").alias("one")).groupBy(F.col("one.lang").alias("lang")).agg(F.count("*").alias("n"))
    both = first("board_move").select("lang", F.col("n").alias("a"), F.lit(0).alias("b")).unionByName(first("all").select("lang", F.lit(0).alias("a"), F.col("n").alias("b")))
    return both.groupBy("lang").agg(F.sum("a").alias("by_board_move"), F.sum("b").alias("by_all"))


@query(f"WITH {_GATED}, {_HELD} SELECT lang, count(*) AS n FROM gated ANTI JOIN held USING (key) GROUP BY lang")
def heldout_anti_join(spark, sf) -> DataFrame:
    return J.held_out(gated(spark, sf), held_keys(spark, sf), "key").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {_GATED}, {_HELD} SELECT count(*) AS n FROM (SELECT key FROM gated INTERSECT SELECT key FROM held)")
def leak_intersection(spark, sf) -> DataFrame:
    return gated(spark, sf).select("key").intersect(held_keys(spark, sf)).agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0 UNION SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY ALL")
def union_of_exclusion_keys(spark, sf) -> DataFrame:
    """Keys of documents that either label excludes."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    of = lambda test: docs.join(labels.where(test), "doc_id", "left_semi").select("source", "lang")
    return of("quality = 0").union(of("toxic = 1")).distinct().groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS key FROM documents EXCEPT SELECT doc_id FROM labels")
def difference_of_pools(spark, sf) -> DataFrame:
    """Documents of which nothing was said."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key")).subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT s_nationkey AS nation, bool_and(s_nationkey IN (SELECT c_nationkey FROM customer)) AS covered FROM supplier GROUP BY 1")
def coverage_superset(spark, sf) -> DataFrame:
    have = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(True).alias("there")).distinct()
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).join(have, "nation", "left")
    return rows.groupBy("nation").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("covered"))


@query("SELECT origin, lang, count(*) AS n FROM (SELECT 'bulk' AS origin, lang FROM documents UNION ALL SELECT 'gold', lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY ALL")
def bag_union_with_source(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    gold = docs.join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")
    both = docs.select(F.lit("bulk").alias("origin"), "lang").unionByName(gold.select(F.lit("gold").alias("origin"), "lang"))
    return both.groupBy("origin", "lang").agg(F.count("*").alias("n"))


@query("SELECT 'n_chars' AS field, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS differing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS DISTINCT FROM CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END) FROM documents")
def row_identity_check(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    other = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    return J.identical_rows(docs, other, "doc_id", ["n_chars", "lang"])


@query(r"""SELECT doc_id, CAST(coalesce(max(run), 0) AS INTEGER) AS longest FROM (SELECT doc_id, count(*) FILTER (WHERE short) AS run FROM
  (SELECT doc_id, pos, short, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM
    (SELECT doc_id, generate_subscripts(w, 1) AS pos, regexp_matches(unnest(w), '^[a-z]{1,3}$') AS short FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents))) GROUP BY doc_id, grp) GROUP BY doc_id""")
def longest_token_run(spark, sf) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return table(spark, sf, "documents").select("doc_id", T.longest_run(words, lambda t: t.rlike("^[a-z]{1,3}$")).alias("longest"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?i)[#*$%&]{3}') || regexp_extract_all(text, '[0-9]+\.[0-9]+'))) AS hits FROM documents""")
def distinct_leak_snippets(spark, sf) -> DataFrame:
    hits = T.leaks(F.col("text"), (r"(?i)[#*$%&]{3}", r"[0-9]+\.[0-9]+"))
    return table(spark, sf, "documents").select("doc_id", F.array_sort(hits).alias("hits"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(160), ' '), '\s+', ' ', 'g')) AS body FROM pages""")
def html_clean(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.untagged(F.col("html")).alias("body"))


@query(r"""WITH l AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT conv_id, turn, list_transform(string_split(text, E'\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS p FROM conversations)),
  k AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS before FROM l WHERE line <> '')
  SELECT conv_id, string_agg(line, ' ' ORDER BY turn, pos) AS transcript FROM k WHERE before IS DISTINCT FROM line GROUP BY conv_id""")
def caption_dedup_adjacent(spark, sf) -> DataFrame:
    from sievework.sources.captions import collapse_adjacent

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", T.squeezed(F.col("line"))).where("line <> ''")
    return collapse_adjacent(rows, "conv_id", ["turn", "pos"], "line").withColumnRenamed("joined", "transcript")


@query(r"""SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS first_user, min_by(text, turn) FILTER (WHERE role = 'assistant') AS first_assistant FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0""")
def chat_pairs(spark, sf) -> DataFrame:
    from sievework.sources.chat import first_pair

    return first_pair(table(spark, sf, "conversations"))


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body FROM documents""")
def whitespace_normalised(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.squeezed(F.col("text")).alias("body"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, CAST(ceil(len(w) / 50.0) AS INTEGER) AS n FROM w),
  p AS (SELECT doc_id, w, CASE WHEN n <= 4 THEN range(n) ELSE list_sort(list_distinct(list_transform(range(4), lambda k: CAST(round_even(k * (n - 1) / 3.0, 0) AS BIGINT)))) END AS places FROM n)
  SELECT doc_id, array_to_string(list_transform(places, lambda i: array_to_string(w[CAST(i * 50 + 1 AS BIGINT):CAST(i * 50 + 50 AS BIGINT)], ' ')), ' ... ') AS digest FROM p""")
def digest_even_chunks(spark, sf) -> DataFrame:
    words = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.words_of(F.col("text")).alias("words"))
    return words.select("doc_id", T.even_chunks(F.col("words"), 50, 4, " ... ").alias("digest"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_widest_span(spark, sf) -> DataFrame:
    wrapped = F.concat(F.lit("reply: ```json\n"), "props", F.lit("\n``` thanks"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(K.widest_json(wrapped), "$.k").cast("long").alias("k"))


@query(r"""WITH r AS (SELECT event_id, [['c','a','x'], ['B','b','d'], ['d'], []][CAST(event_id % 4 AS INTEGER) + 1] AS raw FROM events),
  v AS (SELECT event_id, list_filter(list_transform(raw, lambda x: upper(x)), lambda x: list_contains(['A','B','C','D'], x)) AS said FROM r)
  SELECT event_id, array_to_string(list_concat(list_filter(said, lambda x, i: list_position(said, x) = i), list_filter(['A','B','C','D'], lambda x: NOT list_contains(said, x))), '') AS ranking FROM v""")
def ranking_repair(spark, sf) -> DataFrame:
    raw = F.get(F.array(F.array(F.lit("c"), F.lit("a"), F.lit("x")), F.array(F.lit("B"), F.lit("b"), F.lit("d")), F.array(F.lit("d")), F.array().cast("array<string>")), (F.col("event_id") % 4).cast("int"))
    labels = F.array(*map(F.lit, "ABCD"))
    return table(spark, sf, "events").select("event_id", F.array_join(K.repaired_ranking(raw, labels), "").alias("ranking"))


@query(r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE greatest(0.0, least(10.0, value / 5)) END::DOUBLE AS grade, CAST(greatest(0, least(2, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) END, 0))) AS INTEGER) AS score FROM events""")
def grade_clamp(spark, sf) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("value") / 5).cast("string"))
    whole = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.floor("value").cast("string"))
    return table(spark, sf, "events").select("event_id", K.clamped_grade(raw).alias("grade"), K.clamped_score(whole).alias("score"))


@query(r"""SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 4 <> 3 AND NOT (doc_id % 4 = 0 AND lang = 'en') AS truthful, CAST(CASE WHEN doc_id % 4 = 1 OR (doc_id % 4 = 0 AND lang = 'en') THEN 1 ELSE 0 END AS INTEGER) AS n_flagged, doc_id % 4 = 3 AS inconclusive FROM documents""")
def verdict_parse(spark, sf) -> DataFrame:
    one = F.lit('so: {"violations": [{"claim": "x", "reason": "y"}], "truthful": true} end')
    reply = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("lang") == "en", one).otherwise(F.lit('{"truthful": true}'))).when(F.col("doc_id") % 4 == 1, F.lit('{"flagged": [{"claim": "a"}]}')).when(F.col("doc_id") % 4 == 2, F.lit('{"flagged": []}')).otherwise(F.lit("no idea"))
    return table(spark, sf, "documents").select("doc_id", K.verdict(reply).alias("v")).select("doc_id", "v.*")


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) + 0 AS n FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents)""")
def sentence_counts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"))


@query("""SELECT page_id, coalesce(CASE WHEN t.band IS NOT NULL THEN t.band END, 'none') AS band FROM pages p LEFT JOIN (SELECT * FROM (VALUES ('fr', 'front'), ('de', 'rear')) v(code, band)) t ON regexp_matches(p.url, '/' || t.code || '/')""")
def regex_theta_lookup(spark, sf) -> DataFrame:
    rows = J.by_pattern(table(spark, sf, "pages"), "url", [("front", "/fr/"), ("rear", "/de/")])
    return rows.select("page_id", F.coalesce("family", F.lit("none")).alias("band"))


@query("""SELECT doc_id, 'Level: ' || lang || chr(10) || 'Source: ' || CASE WHEN source = 'src0' THEN '(none provided)' ELSE source END || chr(10) || 'Size: ' || n_chars AS prompt FROM documents""")
def template_fill(spark, sf) -> DataFrame:
    values = {"lang": F.col("lang"), "source": F.when(F.col("source") != "src0", F.col("source")), "n": F.col("n_chars").cast("string")}
    return table(spark, sf, "documents").select("doc_id", T.filled("Level: {lang}\nSource: {source}\nSize: {n}", values).alias("prompt"))


@query("SELECT doc_id, item_id FROM (SELECT doc_id, CAST(substr(text, 1, 0) || (doc_id % 50) AS BIGINT) AS item_id FROM documents) SEMI JOIN benchmark USING (item_id)")
def key_list_semi_join(spark, sf) -> DataFrame:
    keys = table(spark, sf, "benchmark").select("item_id")
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50).alias("item_id")).join(keys, "item_id", "left_semi").select("doc_id", "item_id")
