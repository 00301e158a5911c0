"""Queries over report-level aggregations and the rest of the text and struct functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import buckets as B
from sievework.functions import structs as K
from sievework.functions import text as T
from sievework.operators import reports as R
from sievework.operators import select as S
from sievework.plans.banding import _TRIAD
from sievework.plans.coaching import _NAMES, _R, rows
from sievework.plans.fixtures import FACT, POOL, fact, pool
from sievework.plans.registry import query
from sievework.plans.sqltext import clause_sql, lead_sql
from sievework.session import table

_CELLS = "cells AS (SELECT item, model, bool_or(fit) AS fit, bool_or(sound) AS sound, bool_and(fabricated) AS fabricated FROM fact GROUP BY ALL)"


@query(f"""WITH {FACT} SELECT model, count(*) AS n, count(*) FILTER (WHERE (tokens % 9 = 0) = fabricated) AS agree, count(*) FILTER (WHERE tokens % 9 = 0 AND NOT fabricated) AS newly_flagged, count(*) FILTER (WHERE tokens % 9 <> 0 AND fabricated) AS cleared, count(*) FILTER (WHERE pick >= 7) AS unknown FROM fact GROUP BY model""")
def reverification_audit(spark, sf) -> DataFrame:
    return R.reverified(fact(spark, sf), ["model"], "fabricated", F.col("tokens") % 9 == 0, F.col("pick") < 7)


@query(f"""WITH {FACT}, p AS (SELECT model, level, avg(fit::INT) AS h, sum(sound::INT) AS k, sum((grade IS NOT NULL)::INT) AS w, count(*) AS n FROM fact GROUP BY ALL) SELECT model, round(avg(h), 4) AS hit_rate, round(sum(k) / sum(n), 4) AS named_rate, round(sum(w) / sum(n), 4) AS format_rate FROM p GROUP BY model""")
def condition_score_card(spark, sf) -> DataFrame:
    return R.condition_card(fact(spark, sf), "model", "level", "fit", "sound", F.col("grade").isNotNull())


@query(f"""WITH {FACT}, m AS (SELECT level AS axis, avg(fit::INT) FILTER (WHERE model = 1) AS u, avg(fit::INT) FILTER (WHERE model = 2) AS a, avg(fit::INT) FILTER (WHERE model = 3) AS b FROM fact GROUP BY level)
  SELECT axis, round(u - a, 4) AS delta_first, round(u - b, 4) AS delta_second, u - a >= -0.05 AND u - b >= -0.05 AS kept, u - a > 0 AND u - b > 0 AS improved FROM m""")
def axis_comparison(spark, sf) -> DataFrame:
    of = lambda n: F.avg(F.when(F.col("model") == n, F.col("fit").cast("double")))
    return R.axis_comparison(fact(spark, sf).groupBy(F.col("level").alias("axis")).agg(of(1).alias("u"), of(2).alias("a"), of(3).alias("b")), "axis", "u", "a", "b")


@query(f"""WITH {FACT}, {_CELLS}, c AS (SELECT *, fit AND sound AND NOT fabricated AS clean FROM cells), o AS (SELECT item, bool_or(clean) FILTER (WHERE model = 1) AS ours, bool_or(NOT clean) FILTER (WHERE model <> 1) AS weak, bool_or(clean) FILTER (WHERE model <> 1) AS strong FROM c GROUP BY item)
  SELECT item, CASE WHEN NOT ours AND strong THEN 'loses' WHEN ours AND weak THEN 'wins' ELSE 'even' END AS outcome FROM o WHERE ours IS NOT NULL AND weak IS NOT NULL""")
def outcome_explanation(spark, sf) -> DataFrame:
    cells = fact(spark, sf).groupBy("item", "model").agg(F.bool_or("fit").alias("fit"), F.bool_or("sound").alias("sound"), F.bool_and("fabricated").alias("fabricated"))
    return R.outcome_reasons(cells, "item", "model", 1)


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'broke' WHEN event_id % 50 = 1 THEN 'held' WHEN event_id % 13 <= 6 THEN 'broke' WHEN event_id % 13 <= 8 THEN 'wobbled' WHEN event_id % 7 <> 3 THEN 'broke' WHEN event_type = 'error' THEN 'broke' WHEN user_id % 9 > 6 THEN 'broke' WHEN user_id % 9 > 4 THEN 'wobbled' ELSE 'held' END AS verdict FROM events""")
def adversarial_verdicts(spark, sf) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 50 == 0, 503).when(e % 50 == 1, 422).otherwise(200)
    v = R.case_verdict(status, F.lit(3), e % 7, e % 13, F.col("event_type") == "error", F.col("user_id") % 9, F.lit(4))
    return table(spark, sf, "events").select("event_id", v.alias("verdict"))


@query(f"""WITH {FACT} SELECT model, round(50 * avg(fit::INT) + 25 * avg(grade / 12) + 25 * (0.5 * avg(sound::INT) + 0.5 * avg((NOT fabricated)::INT)), 4) AS score FROM fact GROUP BY model""")
def prompt_scores(spark, sf) -> DataFrame:
    r = fact(spark, sf).select("model", F.col("fit").alias("hit"), "grade", F.col("sound").alias("no_jargon"), (~F.col("fabricated")).alias("clean"))
    return R.prompt_score(r, "model")


@query(f"""WITH {FACT}, o AS (SELECT item, level, max(pick) AS pick FROM fact GROUP BY ALL), f AS (SELECT *, arg_min(pick, CASE level WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END) OVER (PARTITION BY item) AS f FROM o), k AS (SELECT item, count(DISTINCT pick) AS kinds FROM o GROUP BY item)
  SELECT item, level, pick <> f AS changed, kinds >= 2 AS adapts, kinds = 1 AS flat FROM f JOIN k USING (item)""")
def side_by_side_flags(spark, sf) -> DataFrame:
    o = fact(spark, sf).groupBy("item", "level").agg(F.max("pick").alias("pick"))
    place = F.when(F.col("level") == "beginner", 0).when(F.col("level") == "intermediate", 1).otherwise(2)
    return R.side_by_side(o, "item", place, "pick").select("item", "level", "changed", "adapts", "flat")


@query("""WITH c AS (SELECT lang, length(text) > 500 AS long, text LIKE '%.%' AS stop, n_chars = length(text) AS counted FROM documents), g AS (SELECT coalesce(lang, 'overall') AS lang, count(*) AS n, count(*) FILTER (WHERE long) AS a, count(*) FILTER (WHERE stop) AS b, count(*) FILTER (WHERE counted) AS c FROM c GROUP BY ROLLUP (lang))
  SELECT lang, 'long' AS check, round(100 * a / n, 2) AS percent FROM g UNION ALL SELECT lang, 'stop', round(100 * b / n, 2) FROM g UNION ALL SELECT lang, 'counted', round(100 * c / n, 2) FROM g""")
def gate_pass_rates(spark, sf) -> DataFrame:
    c = table(spark, sf, "documents").select("lang", (F.length("text") > 500).alias("long"), F.contains("text", F.lit(".")).alias("stop"), (F.length("text") == F.col("n_chars")).alias("counted"))
    return R.pass_rates(c, "lang", ["long", "stop", "counted"])


@query(f"""WITH {POOL}, {_TRIAD} SELECT count(*) AS boards, round(avg((b <> a)::INT), 3) AS discriminating, 0::BIGINT AS collapsed, count(*) FILTER (WHERE b = a AND i <> b) AS broken FROM fixed""")
def label_statistics(spark, sf) -> DataFrame:
    return R.label_statistics(S.triads(pool(spark, sf)))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'loss' WHEN 'click' THEN 'draw' WHEN 'error' THEN 'win' END AS own FROM events""")
def tablebase_inversion(spark, sf) -> DataFrame:
    said = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "win", "click", "cursed-win", "error", "maybe-loss")]), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", B.tablebase_result(said).alias("own"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'b' END, CASE WHEN o_totalprice > 300000 THEN 'i' END, 'a') AS level FROM orders""")
def display_level(spark, sf) -> DataFrame:
    items = F.array(F.struct(F.lit("b").alias("l"), (F.col("o_orderstatus") == "F").alias("x"), F.lit(False).alias("y")), F.struct(F.lit("i").alias("l"), F.lit(False).alias("x"), (F.col("o_totalprice") > 300000).alias("y")))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(B.first_that(items, lambda t: t["x"], lambda t: t["y"])["l"], F.lit("a")).alias("level"))


@query(r"""WITH t AS (SELECT page_id, page_id % 3000 + 100 AS n, CASE page_id % 5 WHEN 0 THEN 'Game at ' || (600 + page_id % 900) || '+ Elo' WHEN 1 THEN 'Rated: ' || (1000 + page_id % 500) || ' climb' WHEN 2 THEN 'From ' || (1000 + page_id % 100) || ' – 1300' WHEN 3 THEN 'Episode 12 of 20' ELSE 'In ' || (page_id % 4000) || ' games, ' || (700 + page_id % 90) || ' wins' END AS title FROM pages),
  x AS (SELECT *, nullif(regexp_extract(title, '(?i)\b(\d{3,4})\+?\s*(?:elo|rated|rating)\b', 1), '')::INT AS a, nullif(regexp_extract(title, '(?i)\b(?:elo|rated|rating)\s*:?\s*(\d{3,4})\b', 1), '')::INT AS b, regexp_extract(title, '\b(\d{3,4})\s*[-–]\s*(\d{3,4})\b', ['u', 'v']) AS r, list_filter(list_transform(regexp_extract_all(title, '\b(\d{3,4})\b', 1), lambda y: y::INT), lambda y: y BETWEEN 600 AND 2800)[1] AS bare FROM t)
  SELECT page_id, n, coalesce(a, b, CASE WHEN r.u <> '' THEN (TRY_CAST(r.u AS INT) + TRY_CAST(r.v AS INT)) // 2 END, bare)::INT AS rating FROM x""")
def rating_from_title(spark, sf) -> DataFrame:
    p, m = F.col("page_id"), F.col("page_id") % 5
    title = F.when(m == 0, F.concat(F.lit("Game at "), 600 + p % 900, F.lit("+ Elo"))).when(m == 1, F.concat(F.lit("Rated: "), 1000 + p % 500, F.lit(" climb"))).when(m == 2, F.concat(F.lit("From "), 1000 + p % 100, F.lit(" – 1300"))).when(m == 3, F.lit("Episode 12 of 20"))
    title = title.otherwise(F.concat(F.lit("In "), p % 4000, F.lit(" games, "), 700 + p % 90, F.lit(" wins")))
    return table(spark, sf, "pages").select("page_id", (p % 3000 + 100).alias("n"), T.rating_of_title(title).alias("rating"))


@query(f"""WITH {_R} SELECT k, {lead_sql('body')} AS lead FROM r""")
def cleaned_leads(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.clean_lead(F.col("body")).alias("lead"))


@query(f"""WITH {_R}, f AS (SELECT k, takeaway, level AS tier, body AS lead, {_NAMES.format('takeaway')} AS named FROM r)
  SELECT k, named, CASE WHEN named THEN takeaway ELSE trim({clause_sql('space')} || CASE WHEN takeaway = '' THEN '.' ELSE '. ' || takeaway END) END AS takeaway FROM f""")
def takeaway_augmentation(spark, sf) -> DataFrame:
    longer, a = T.takeaway_with_principle(F.col("takeaway"), F.col("body"), F.array(F.lit("space")), F.col("level"))
    return rows(spark, sf).select("k", (~a).alias("named"), longer.alias("takeaway"))


@query(r"""WITH t AS (SELECT doc_id, 'level ' || lang || ['  Takeaway: ', ' TAKEAWAY:', chr(10) || 'takeaway:  '][1 + doc_id % 3] || 'take ' || source || chr(10) || 'more Takeaway: x' AS t, CASE WHEN doc_id % 2 = 0 THEN '<think>a' || chr(10) || 'b</think>' ELSE '<THINK>' || lang || '</Think> <think>c</think>' END || 'hmm' || CASE WHEN doc_id % 5 = 0 THEN '</think>' ELSE '' END || ' think ' || doc_id AS x FROM documents),
  p AS (SELECT *, strpos(lower(t), 'takeaway:') AS cut FROM t)
  SELECT doc_id, trim(t[:cut - 1], E' \n') AS body, trim(regexp_extract(t[cut + 9:], '^\s*([^\n]*)', 1)) AS takeaway, trim(regexp_replace(regexp_replace(x, '(?is)<think>.*?</think>', '', 'g'), '(?is)^.*</think>', '')) AS tail FROM p""")
def split_and_strip(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    mark = F.when(d % 3 == 0, "  Takeaway: ").when(d % 3 == 1, " TAKEAWAY:").otherwise("\ntakeaway:  ")
    body, take = T.split_target(F.concat(F.lit("level "), "lang", mark, F.lit("take "), "source", F.lit("\nmore Takeaway: x")))
    thought = F.when(d % 2 == 0, "<think>a\nb</think>").otherwise(F.concat(F.lit("<THINK>"), "lang", F.lit("</Think> <think>c</think>")))
    tail = T.strip_thinking(F.concat(thought, F.lit("hmm"), F.when(d % 5 == 0, "</think>").otherwise(""), F.lit(" think "), d.cast("string")))
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(body, r"\n+$", "").alias("body"), take.alias("takeaway"), tail.alias("tail"))


@query(r"""WITH t AS (SELECT doc_id, '## Intro' || chr(10) || 'x' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## Next' || chr(10) || 'y' || chr(10) ELSE '' END || '## The Beginner tier' || chr(10) || 'about ' || lang || chr(10) || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Last' || chr(10) || 'z' ELSE '' END AS m,
    CASE WHEN doc_id % 4 <> 0 THEN '---' || chr(10) || 'k: ' || source || chr(10) || 'l: 1' || chr(10) || '---' || chr(10) ELSE '' END || 'rest ' || doc_id AS f FROM documents),
  s AS (SELECT *, list_filter(string_split(chr(10) || m, chr(10) || '## '), lambda x: contains(lower(string_split(x, chr(10))[1]), 'beginner'))[1] AS part, strpos(f[5:], chr(10) || '---' || chr(10)) AS cut FROM t)
  SELECT doc_id, trim(part[strpos(part, chr(10)) + 1:], E' \n') AS guide, CASE WHEN starts_with(f, '---' || chr(10)) THEN f[5:cut + 3] END AS header, CASE WHEN starts_with(f, '---' || chr(10)) THEN f[cut + 9:] ELSE f END AS body FROM s""")
def markdown_sections(spark, sf) -> DataFrame:
    d, empty = F.col("doc_id"), F.lit("")
    guide = T.section_of(F.concat(F.lit("## Intro\nx\n"), F.when(d % 3 == 0, "## Next\ny\n").otherwise(empty), F.lit("## The Beginner tier\nabout "), "lang", F.lit("\n\n"), "source", F.when(d % 2 == 0, "\n## Last\nz").otherwise(empty)), "beginner")
    header, body = T.front_matter(F.concat(F.when(d % 4 != 0, F.concat(F.lit("---\nk: "), "source", F.lit("\nl: 1\n---\n"))).otherwise(empty), F.lit("rest "), d.cast("string")))
    return table(spark, sf, "documents").select("doc_id", guide.alias("guide"), header.alias("header"), body.alias("body"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS gid, l_linenumber AS n FROM lineitem), p AS (SELECT gid, count(*) AS n, max(n)::BIGINT AS top, string_agg('  - m' || n || ' (eval ' || n || 'cp) idea: e4 e5', chr(10) ORDER BY n) AS pool, string_agg('  - m' || n || ': ' || n * 10 || '%', chr(10) ORDER BY n) FILTER (WHERE place <= 6) AS human FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n) AS place FROM l) GROUP BY gid)
  SELECT gid, n, top, 'beginner' AS level, 'White' AS side, least(n, 6) AS likely, array_to_string(['Student rating tier: beginner (1000-1200).', 'Board:', '. .', 'White to move.', 'Engine-sound candidate moves [internal reference — never quote these numbers]:', pool, 'Human-likelihood at this tier (Maia):', human, '', 'Recommend exactly ONE move from the sound list. Ply cap: 2.'], chr(10)) AS prompt FROM p""")
def prompt_round_trip(spark, sf) -> DataFrame:
    """A prompt is rendered from nested arrays and read back."""
    moves = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    item = F.struct(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("san"), F.col("l_linenumber").alias("cp"), F.array(F.lit("e4"), F.lit("e5")).alias("pv"), (F.col("l_linenumber") / 10).alias("policy"))
    nested = moves.groupBy(F.col("l_orderkey").alias("gid")).agg(F.array_sort(F.collect_list(item)).alias("pool"))
    prompt = T.rendered_prompt(F.lit("beginner"), F.lit(1000), F.lit(1200), F.lit(". ."), F.lit("White"), F.col("pool"), F.col("pool"), F.lit(2))
    back = T.parsed_prompt(prompt)
    return nested.select("gid", F.size(back["pool"]).cast("long").alias("n"), F.substring(F.element_at(back["pool"], -1), 2, 9).cast("long").alias("top"), back["level"].alias("level"), back["side"].alias("side"), F.size(back["human"]).cast("long").alias("likely"), prompt.alias("prompt"))


@query("""SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'g' || doc_id END], lambda x: x IS NOT NULL) AS found, lang AS level, CASE WHEN doc_id % 4 = 0 THEN [lang, source] ELSE [source] END AS concepts FROM documents""")
def nested_and_aliased_fields(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    doc = F.to_json(F.struct(F.when(d % 2 == 0, F.concat(F.lit("f"), d)).alias("fen"), F.struct(F.when(d % 3 == 0, F.concat(F.lit("g"), d)).alias("fen"), F.col("lang").alias("tier")).alias("teacher_input")))
    raw = F.when(d % 4 == 0, F.to_json(F.array(F.col("lang"), F.lit("  "), F.concat(F.lit(" "), "source")))).otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    return table(spark, sf, "documents").select("doc_id", K.nested_strings(doc).alias("found"), K.aliased(F.get_json_object(doc, "$.tier"), F.get_json_object(doc, "$.teacher_input.tier")).alias("level"), K.string_list(raw).alias("concepts"))


@query("""SELECT event_id, value AS m1, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS m9 FROM events""")
def renamed_and_defaulted_maps(spark, sf) -> DataFrame:
    grades = F.create_map(F.lit("A"), F.col("value"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("Z"), F.lit(-1.0))
    named = K.renamed_keys(grades, F.create_map(F.lit("A"), F.lit("m1"), F.lit("B"), F.lit("m9")))
    return table(spark, sf, "events").select("event_id", K.value_or(named, F.lit("m1")).alias("m1"), K.value_or(named, F.lit("m9")).alias("m9"))


@query(f"""WITH {_R} SELECT k, x.i::INT AS place, ['system', 'user', 'assistant'][x.i] AS role, CASE x.i WHEN 1 THEN 'coach' WHEN 2 THEN level || ': ' || move ELSE body END AS content FROM r, range(1, 4) x(i)""")
def chat_row_build(spark, sf) -> DataFrame:
    out = rows(spark, sf).withColumn("messages", T.chat_row(F.lit("coach"), F.concat("level", F.lit(": "), "move"), F.col("body")))
    return out.select("k", F.posexplode("messages").alias("at", "m")).select("k", (F.col("at") + 1).alias("place"), "m.role", "m.content")


@query(f"""WITH {_R}, i AS (SELECT DISTINCT k // 15 AS item, level, move, 'I''d play ' || move || '. Good.' || CASE WHEN k % 2 = 0 THEN ' Not ' || move || '+ but ' || move ELSE '' END AS text FROM r),
  j AS (SELECT a.item, a.level, a.text AS chosen, a.move, b.move AS rejected_move, regexp_replace(a.text, '(^|[^\\w+#=\\-])' || a.move || '($|[^\\w+#=\\-])', '\\1' || b.move || '\\2', 'g') AS rejected FROM i a JOIN i b ON a.item = b.item AND a.level <> b.level AND a.move <> b.move)
  SELECT item, level, chosen, rejected, move, rejected_move FROM j WHERE rejected <> chosen AND NOT contains(chosen, rejected_move)""")
def swapped_preference_pairs(spark, sf) -> DataFrame:
    from sievework.operators.mix import preference_pairs

    more = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" Not "), "move", F.lit("+ but "), "move")).otherwise("")
    items = rows(spark, sf).select(F.floor(F.col("k") / 15).alias("item"), "level", "move", F.concat(F.lit("I'd play "), "move", F.lit(". Good."), more).alias("text")).distinct()
    return preference_pairs(items, "item", "level", "move", "text").withColumnRenamed("rejected_pick", "rejected_move")
