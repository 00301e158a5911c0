"""Queries over the candidates' gate stacks, on texts and boards dealt over the part table.

Which moves are legal and which sentences are false needs the rules of the game; the SQL has them as a list of the dealt
boards' legal moves and one dealt sentence, read off the boards by hand. All else is computed there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import candidates as N
from sievework.operators import gates as G
from sievework.plans.coaching import _at, _case, _NAMES, _R, rows
from sievework.plans.registry import query
from sievework.plans.sqltext import clause_sql, lead_sql, quoted, run_sql

UCIS = ("g1f3", "e2e4", "f1b5", "e2b5", "")
POOLS = (("g1f3", "e2e4", "f1b5"), ("F1B5", "e2b5"), ())
TIERS = ("beginner", "intermediate", "advanced", "grandmaster")


def candidates(spark, sf) -> DataFrame:
    k = F.col("k")
    pool = F.get(F.array(*[F.array(*map(F.lit, p)).cast("array<string>") for p in POOLS]), (F.floor(k / 2) % len(POOLS)).cast("int"))
    tier, fen = _at(TIERS, F.floor(k / 17)), F.when(k % 29 != 0, F.col("fen"))
    known = F.when(F.col("move") == "Nf3", "g1f3").when(F.col("move") == "e4", "e2e4").when(k % 3 == 0, "e2b5").otherwise("f1b5")
    uci = F.when(k % 23 != 0, F.when(k % 19 == 0, _at(UCIS, k)).otherwise(known))
    coaching = F.when(k % 31 != 0, F.col("body"))
    return rows(spark, sf).select("k", tier.alias("tier"), fen.alias("fen"), uci.alias("rec_uci"), F.when(k % 46 != 0, F.col("move")).alias("rec_san"), coaching.alias("coaching"), "method", "takeaway", F.array(F.lit("open file")).alias("concepts"), pool.alias("sound_ucis"), known.alias("canonical_uci"))


_CAND = f"""{_R}, c0 AS (SELECT k, ['beginner', 'intermediate', 'advanced', 'grandmaster'][1 + (k // 17) % 4] AS tier, CASE WHEN k % 29 <> 0 THEN fen ELSE '' END AS fen, (k // 13) % 6 AS b, move,
    CASE move WHEN 'Nf3' THEN 'g1f3' WHEN 'e4' THEN 'e2e4' ELSE CASE WHEN k % 3 = 0 THEN 'e2b5' ELSE 'f1b5' END END AS known, CASE WHEN k % 46 <> 0 THEN move ELSE '' END AS san, CASE WHEN k % 31 <> 0 THEN trim(body) ELSE '' END AS coaching, trim(method) AS method, trim(takeaway) AS takeaway,
    [['g1f3', 'e2e4', 'f1b5'], ['f1b5', 'e2b5'], []::VARCHAR[]][1 + (k // 2) % 3] AS pool, k % 10 AS s FROM r),
  c1 AS (SELECT *, CASE WHEN k % 23 = 0 THEN '' WHEN k % 19 = 0 THEN ['g1f3', 'e2e4', 'f1b5', 'e2b5', ''][1 + k % 5] ELSE known END AS uci FROM c0),
  moves(b, san, uci) AS (VALUES (0, 'Nf3', 'g1f3'), (0, 'e4', 'e2e4'), (1, 'Bb5', 'f1b5'), (3, 'Bb5', 'e2b5'), (3, 'Bb5', 'x')),
  c2 AS (SELECT *, CASE WHEN fen <> '' AND (uci <> '' OR san <> '') THEN EXISTS (SELECT 1 FROM moves m WHERE m.b = c1.b AND (m.uci = c1.uci OR m.san = c1.san)) END AS legal,
    CASE WHEN coaching <> '' AND s = 4 AND b <> 1 AND fen <> '' THEN 1 ELSE 0 END AS false_, list_contains(pool, uci) AND uci <> '' AS sound, CASE tier WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 4 ELSE 6 END AS cap,
    CAST({run_sql('coaching')} AS INTEGER) AS run FROM c1)"""
_LEAK = "regexp_matches({0}, '(?i)\\d+\\s*cp\\b|\\bcentipawns?\\b|\\beval|\\bengines?\\b|\\bstockfish\\b|\\bcomputers?\\b|#\\d|(^|[^A-Za-z0-9_])[+-]\\d')"


def _listed(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL)"


def _bank(reject: bool, stripped: bool) -> str:
    coaching = "CASE WHEN false_ = 1 THEN 'The move is Bb5.' ELSE coaching END" if stripped else "coaching"
    tests = [("missing_tier", "tier = 'grandmaster'"), ("faithfulness", f"{str(reject).lower()} AND false_ = 1"), ("missing_recommendation", "uci = '' AND san = ''"), ("soundness", "(uci <> '' OR san <> '') AND NOT sound"),
             ("engine_speak", _LEAK.format("kept || chr(10) || takeaway")), ("ply_cap", "run > cap"), ("missing_fen", "fen = ''"), ("illegal_move", "NOT legal"), ("empty_coaching", "kept = ''"), ("empty_takeaway", "takeaway = ''"), ("missing_method", "method = ''")]
    return f"WITH {_CAND}, c3 AS (SELECT *, {coaching} AS kept FROM c2), c4 AS (SELECT *, {_listed(tests)} AS why FROM c3)"


@query(f"""{_bank(True, False)}, d AS (SELECT *, CASE WHEN len(why) = 0 AND row_number() OVER (PARTITION BY fen, tier, lower(uci), len(why) = 0 ORDER BY k) > 1 THEN ['duplicate'] ELSE why END AS reasons FROM c4)
  SELECT k, array_to_string(reasons, ',') AS reasons FROM d""")
def bank_gate_reject(spark, sf) -> DataFrame:
    """All reason codes of the stack with false sentences rejected, then duplicates by position, level and move."""
    out = N.bank_gate(candidates(spark, sf), "reject", with_method=True).withColumn("move_key", F.lower("rec_uci"))
    return G.first_clean(out, ["fen", "tier", "move_key"], ["k"]).select("k", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_bank(False, True)} SELECT k, kept AS coaching, array_to_string(why, ',') AS reasons FROM c4""")
def bank_gate_strip(spark, sf) -> DataFrame:
    """The same with false sentences taken out before the other tests."""
    out = N.bank_gate(candidates(spark, sf), "strip", with_method=True)
    return out.select("k", "coaching", F.array_join("reasons", ",").alias("reasons"))


def _scrub(column: str) -> str:
    out = column
    for pattern, plain in T.SCRUBS:
        out = f"regexp_replace({out}, {quoted(pattern)}, '{plain}', 'g')"
    return f"CASE WHEN tier = 'beginner' THEN {out} ELSE {column} END"


_MADE = "regexp_replace({0}, '  +', ' ', 'g')"
_TARGET = "trim(trim('I''d play ' || san || '. ' || lead) || CASE WHEN method <> '' THEN ' How to find it: ' || method ELSE '' END || ' Takeaway: ' || {0})"
_FIRST = [("empty_coaching", "coaching = ''"), ("missing_method", "method = ''"), ("empty_takeaway", "takeaway = ''")]
_LEAD = [("format_lead", "NOT starts_with(target, 'I''d play ' || san || '.')"), ("format_takeaway", "NOT contains(target, 'Takeaway:')")]
# After the lead the target narrates the move and then what is left of the body; the plies of the dealt texts follow from their words.
_RUN = "run_of_target > cap"


@query(f"""WITH {_CAND}, c3 AS (SELECT *, {lead_sql('coaching')} AS lead, {_NAMES.format('takeaway')} AS native FROM c2),
  c4 AS (SELECT *, {_MADE.format('(' + _scrub(_MADE.format(_TARGET.format('takeaway'))) + ')')} AS target FROM c3), c5 AS (SELECT *, {run_sql('target')} AS run_of_target, {_case(T.BAD_HEURISTICS, 'target')} AS bad FROM c4),
  c6 AS (SELECT *, {_listed([*_FIRST, ('missing_move', "uci = ''"), ('tier_move_mismatch', "uci <> '' AND uci <> known"), ('soundness', "uci <> '' AND NOT sound"), ('illegal_move', 'NOT legal')])} AS one,
    list_filter([CASE WHEN {_LEAK.format('target')} THEN 'engine_speak' END, CASE WHEN {_RUN} THEN 'ply_cap' END, CASE WHEN NOT starts_with(target, 'I''d play ' || san || '.') THEN 'format_lead' END, CASE WHEN NOT native THEN 'no_principle_in_takeaway' END,
      CASE WHEN bad IS NOT NULL THEN 'bad_heuristic:' || bad END, CASE WHEN fen <> '' AND ((s = 4 AND b <> 1) OR s = 3) THEN 'faithfulness_ext' END], lambda x: x IS NOT NULL) AS two FROM c5)
  SELECT k, native, array_to_string(CASE WHEN len(one) > 0 THEN one ELSE two END, ',') AS reasons FROM c6""")
def curation_gate_reasons(spark, sf) -> DataFrame:
    out = N.curation_gate(candidates(spark, sf))
    return out.select("k", "native", F.array_join("reasons", ",").alias("reasons"))


def _grounded(target: str, run: str) -> str:
    return f"""c4 AS (SELECT *, {target} AS target FROM c3), c5 AS (SELECT *, {run} AS run_of_target FROM c4),
  c6 AS (SELECT *, {_listed([('missing_tier', "tier = 'grandmaster'"), ('missing_fen', "fen = ''"), *_FIRST, ('soundness', 'NOT sound'), ('illegal_move', 'NOT legal')])} AS one,
    {_listed([('engine_speak', _LEAK.format('target')), ('ply_cap', _RUN), *_LEAD, ('faithfulness_narrow', 'false_ = 1')])} AS two FROM c5)
  SELECT k, target, array_to_string(CASE WHEN len(one) > 0 THEN one ELSE two END, ',') AS reasons FROM c6"""


@query(f"""WITH {_CAND}, c3a AS (SELECT *, {lead_sql('coaching')} AS lead FROM c2), c3 AS (SELECT *, CASE WHEN {_NAMES.format('takeaway')} THEN takeaway ELSE trim({clause_sql('open_file_rook')} || CASE WHEN takeaway = '' THEN '.' ELSE '. ' || takeaway END) END AS own FROM c3a),
  {_grounded(_MADE.format('(' + _scrub(_MADE.format(_TARGET.format('own'))) + ')'), run_sql('target'))}""")
def grounded_gate_augmented(spark, sf) -> DataFrame:
    out = N.grounded_gate(candidates(spark, sf))
    return out.select("k", "target", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_CAND}, c3 AS (SELECT *, trim(CASE WHEN san <> '' THEN regexp_replace(coaching, '(?i)^\\s*(?:i[''’]?d\\s+play|let[''’]?s\\s+play|play|consider|go\\s+with)\\s+' || san || '\\b[\\s.:,;!\\-]*', '') ELSE regexp_replace(coaching, '(?i)^\\s*(?:play|consider)\\s+\\b[\\s.:,;!\\-]*', '') END) AS lead FROM c2),
  {_grounded(_TARGET.format('takeaway'), run_sql("coaching || ' ' || method"))}""")
def grounded_gate_plain(spark, sf) -> DataFrame:
    out = N.grounded_gate(candidates(spark, sf), augment=False)
    return out.select("k", "target", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_CAND}, c3 AS (SELECT *, coaching AS lead FROM c2), c4 AS (SELECT *, CASE WHEN k % 8 = 0 THEN coaching ELSE {_TARGET.format('takeaway')} END AS target FROM c3)
  SELECT k, starts_with(target, 'I''d play ' || san || '.') AND contains(target, 'Takeaway:') AND NOT {_LEAK.format('target')} AND {run_sql('target')} <= cap AND false_ = 0 AS passes FROM c4""")
def target_gate_passes(spark, sf) -> DataFrame:
    rows_ = N.tidy(candidates(spark, sf))
    made = T.rendered_target(F.col("rec_san"), F.col("coaching"), F.col("method"), F.col("takeaway"))
    return N.target_gate(rows_.withColumn("target", F.when(F.col("k") % 8 == 0, F.col("coaching")).otherwise(made))).select("k", "passes")
