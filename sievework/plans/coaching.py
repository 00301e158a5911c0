"""Queries over coaching texts and encoded boards, on fixed sentences and boards dealt over the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.board import columns as C
from sievework.functions import buckets as B
from sievework.functions import text as T
from sievework.operators import gates as G
from sievework.plans.registry import query
from sievework.plans.sqltext import run_sql
from sievework.session import spread, table

BODIES = (
    "Play Nf3. And it develops the knight toward e5 and d4.", "This pawn push on e4 controls d5; castling comes next.", "The rook on the open file looks at e8 and e1.", "Trade pieces when you are behind in material.",
    "The move is Bb5. It pins the knight on c6.", "An engine says +1.3 here.", "Always castle early in the game.", "The initiative and tempo matter: gain a tempo first.", "Nothing much happens.", "1. e4 e5 2. Nf3 Nc6 3. Bb5 is the line.",
)
TAKEAWAYS = ("Fight for the center.", "Be patient.", "", "Improve your worst piece.", "Look around.")
METHODS = ("Ask which piece is loose before you move.", "short", "", "It goes there because it is good over there.")
MOVES = ("Nf3", "e4", "Bb5")
BOARDS = (
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq - 2 3", "8/8/8/4k3/8/4K3/4P3/8 w - - 0 60", "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 15",
    "4k3/8/8/3q4/8/8/3R4/4K3 b - - 5 41", "8/P7/8/8/8/8/7p/k6K w - - 0 50",
)
LEVELS = ("beginner", "intermediate", "advanced")


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values, n) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def rows(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf, "part").select("p_partkey")).select(k.alias("k"), _at(BODIES, k).alias("body"), _at(TAKEAWAYS, F.floor(k / 3)).alias("takeaway"), _at(METHODS, F.floor(k / 7)).alias("method"), _at(MOVES, F.floor(k / 5)).alias("move"), _at(LEVELS, F.floor(k / 11)).alias("level"), _at(BOARDS, F.floor(k / 13)).alias("fen"))


_R = f"""r AS (SELECT p_partkey AS k, {_sql(BODIES)}[1 + p_partkey % 10] AS body, {_sql(TAKEAWAYS)}[1 + (p_partkey // 3) % 5] AS takeaway, {_sql(METHODS)}[1 + (p_partkey // 7) % 4] AS method,
  {_sql(MOVES)}[1 + (p_partkey // 5) % 3] AS move, {_sql(LEVELS)}[1 + (p_partkey // 11) % 3] AS level, {_sql(BOARDS)}[1 + (p_partkey // 13) % 6] AS fen FROM part)"""


def _case(named, text) -> str:
    q = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{q(p)}') THEN '{n}'" for n, p in named) + " END"


_NAMES = "(" + " OR ".join("regexp_matches({0}, '" + p.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')" for _, p in T.PRINCIPLES) + ")"


@query(f"WITH {_R} SELECT k, {_case(T.BAD_HEURISTICS, 'body')} AS heuristic FROM r")
def rejected_heuristics(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.bad_heuristic(F.col("body")).alias("heuristic"))


@query(f"WITH {_R} SELECT k, {_NAMES.format('takeaway')} AS named, {_case(T.PRINCIPLES, 'body')} AS family, {_case(T.TACTICS, 'body')} AS tactic FROM r")
def principle_vocabulary(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.names_principle(F.col("takeaway")).alias("named"), T.first_named(F.col("body"), T.PRINCIPLES).alias("family"), T.first_named(F.col("body"), T.TACTICS).alias("tactic"))


@query(f"WITH {_R} SELECT k, regexp_matches(body, '(?i)\\d+\\s*cp\\b|\\bcentipawns?\\b|\\beval|\\bengines?\\b|\\bstockfish\\b|\\bcomputers?\\b|#\\d|(^|[^A-Za-z0-9_])[+-]\\d') AS leak FROM r")
def vocabulary_leaks(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", (F.size(T.leaks(F.col("body"))) > 0).alias("leak"))


@query(f"""WITH {_R} SELECT k, CAST({run_sql('body')} AS INTEGER) AS plies FROM r""")
def longest_move_runs(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.longest_move_run(F.col("body")).alias("plies"))


@query(f"""WITH {_R}, s AS (SELECT k, level, body, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?i)\\bwith tempo\\b', 'for free', 'g'), '(?i)\\bgain(?:ing|s)?\\s+a?\\s*tempo\\b', 'gain time', 'g'), '(?i)\\ba tempo\\b', 'time', 'g'), '(?i)\\btempi\\b', 'moves', 'g'), '(?i)\\btempo\\b', 'time', 'g'), '(?i)\\bthe initiative\\b', 'the attack', 'g'), '(?i)\\binitiative\\b', 'pressure', 'g') AS b FROM r)
  SELECT k, CASE WHEN level = 'beginner' THEN b ELSE body END AS body FROM s""")
def beginner_scrub(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.beginner_scrub(F.col("body"), F.col("level")).alias("body"))


@query(f"""WITH {_R}, t AS (SELECT k, trim('I''d play ' || move || '. ' || body) || CASE WHEN method <> '' THEN ' How to find it: ' || method ELSE '' END || ' Takeaway: ' || takeaway AS t FROM r) SELECT k, regexp_replace(trim(t), '  +', ' ', 'g') AS target FROM t""")
def rendered_targets(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", T.rendered_target(F.col("move"), F.col("body"), F.col("method"), F.col("takeaway")).alias("target"))


@query(f"""WITH {_R}, t AS (SELECT *, regexp_replace(trim(trim('I''d play ' || move || '. ' || body) || CASE WHEN method <> '' THEN ' How to find it: ' || method ELSE '' END || ' Takeaway: ' || takeaway), '  +', ' ', 'g') AS target FROM r),
  w AS (SELECT *, len(list_filter(string_split_regex(target, '\\s+'), lambda x: x <> '')) AS words, CASE level WHEN 'beginner' THEN 55 WHEN 'intermediate' THEN 85 ELSE 100 END AS lo, CASE level WHEN 'beginner' THEN 145 WHEN 'intermediate' THEN 185 ELSE 225 END AS hi FROM t)
  SELECT k, round(least(len(list_distinct(regexp_extract_all(body, '\\b([a-h][1-8])\\b', 1))), 4) + CASE WHEN {_NAMES.format('takeaway')} THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(method, '{T.ROUTINE}') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(target, '{T.CONTRAST}') THEN 1.5 ELSE 0 END + 1.0
    + CASE WHEN words BETWEEN lo AND hi THEN 1.5 ELSE -least(CASE WHEN words < lo THEN lo - words ELSE words - hi END / 40.0, 3.0) END - CASE WHEN (length(target) - length(replace(target, move, ''))) / length(move) >= 4 THEN 2.0 ELSE 0 END, 3)::DOUBLE AS score FROM w""")
def rubric_score(spark, sf) -> DataFrame:
    r = rows(spark, sf).withColumn("target", T.rendered_target(F.col("move"), F.col("body"), F.col("method"), F.col("takeaway")))
    score = T.instructiveness(F.col("target"), F.col("body"), F.col("method"), F.col("takeaway"), F.array(F.lit("a"), F.lit("b")), F.col("level"), F.col("move"))
    return r.select("k", score.alias("score"))


@query(f"""WITH {_R} SELECT CASE WHEN length(method) < 20 THEN 'stub' WHEN regexp_matches(method, '{T.ROUTINE}') THEN 'routine' ELSE 'narration' END AS bucket, count(*) AS n FROM r GROUP BY 1""")
def method_buckets(spark, sf) -> DataFrame:
    return rows(spark, sf).groupBy(T.method_bucket(F.col("method")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_R}, e AS (SELECT k, regexp_matches(body, '{T.PURPOSE}') AS purpose, len(list_distinct(regexp_extract_all(body, '\\b([a-h][1-8])\\b', 1))) >= 2 AS squares, length(method) > 15 AS method FROM r) SELECT purpose, squares, method, count(*) AS n FROM e GROUP BY ALL""")
def six_element_audit(spark, sf) -> DataFrame:
    e = T.row_elements(F.col("body"), F.col("body"), F.col("method"), F.col("takeaway"), F.col("move"))
    return rows(spark, sf).select(e["purpose"].alias("purpose"), e["squares"].alias("squares"), e["method"].alias("method")).groupBy("purpose", "squares", "method").agg(F.count("*").alias("n"))


@query(f"""WITH {_R}, g AS (SELECT k, CASE WHEN takeaway = '' THEN ['empty_takeaway'] ELSE list_filter([CASE WHEN {_case(T.BAD_HEURISTICS, 'body')} IS NOT NULL THEN 'heuristic' END, CASE WHEN regexp_matches(body, '(?i)\\bengines?\\b') THEN 'engine_speak' END], lambda x: x IS NOT NULL) END AS reasons FROM r)
  SELECT k, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS kept FROM g""")
def two_stage_gate(spark, sf) -> DataFrame:
    out = G.staged_reasons(rows(spark, sf), [("empty_takeaway", F.col("takeaway") == "")], [("heuristic", T.bad_heuristic(F.col("body")).isNotNull()), ("engine_speak", F.col("body").rlike(r"(?i)\bengines?\b"))])
    return out.select("k", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("kept"))


_PLACE = "string_split(fen, ' ')[1]"
_DRAWN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '1', '.'), '2', '..'), '3', '...'), '4', '....'), '5', '.....'), '6', '......'), '7', '.......'), '8', '........'), '(.)', '\\1 ', 'g'))"


@query(f"WITH {_R} SELECT k, array_to_string(list_transform(string_split({_PLACE}, '/'), lambda x: {_DRAWN}), chr(10)) AS board FROM r")
def drawn_boards(spark, sf) -> DataFrame:
    return rows(spark, sf).select("k", B.drawing_of_board(F.col("fen")).alias("board"))


@query(f"WITH {_R} SELECT k, array_to_string(string_split(fen, ' ')[1:4], ' ') AS key4, array_to_string(string_split(fen, ' ')[1:2], ' ') AS key2, array_to_string(string_split(fen, ' ')[1:2], ' ') AS redrawn FROM r")
def position_keys(spark, sf) -> DataFrame:
    drawn = F.concat(F.lit("Board:\n"), B.drawing_of_board(F.col("fen")), F.lit("\n"), F.when(B.fen_field(F.col("fen"), 1) == "w", "White").otherwise("Black"), F.lit(" to move."))
    return rows(spark, sf).select("k", B.position_key(F.col("fen")).alias("key4"), B.position_key(F.col("fen"), 2).alias("key2"), B.position_key_of_drawing(drawn).alias("redrawn"))


@query(f"""WITH {_R}, n AS (SELECT k, length(regexp_replace({_PLACE}, '[^QRBNqrbn]', '', 'g')) AS m, length(regexp_replace({_PLACE}, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace({_PLACE}, '[^Qq]', '', 'g')) AS q, CAST(string_split(fen, ' ')[6] AS INT) AS f FROM r)
  SELECT k, CASE WHEN m <= 6 THEN 'endgame' WHEN f <= 12 THEN 'opening' ELSE 'middlegame' END AS by_material, CASE WHEN a >= 26 THEN 'opening' WHEN a >= 12 THEN 'middlegame' ELSE 'endgame' END AS by_count, CASE WHEN a <= 12 OR (q = 0 AND a <= 16) THEN 'endgame' WHEN f <= 12 THEN 'opening' ELSE 'middlegame' END AS by_queens FROM n""")
def three_phase_rules(spark, sf) -> DataFrame:
    f = F.col("fen")
    return rows(spark, sf).select("k", B.phase_by_material(f).alias("by_material"), B.phase_by_count(f).alias("by_count"), B.phase_by_queens(f).alias("by_queens"))


# Rows that need the rules of the game: tests hold them against hand-made boards and published counts. The SQL has what was
# read off the dealt boards by hand: their legal moves, and which dealt sentences are false on them.
_LEGAL = "moves(b, san, uci) AS (VALUES (0, 'Nf3', 'g1f3'), (0, 'e4', 'e2e4'), (1, 'Bb5', 'f1b5'), (3, 'Bb5', 'e2b5'))"


def _distinct(spark, sf) -> DataFrame:
    """Boards once each: dear functions run on distinct values and are joined back."""
    return rows(spark, sf).select("fen", "move", "body").distinct()


@query(f"WITH {_R}, {_LEGAL} SELECT k, uci IS NOT NULL AS legal, uci FROM (SELECT *, (k // 13) % 6 AS own FROM r) LEFT JOIN moves ON b = own AND san = move")
def move_legality(spark, sf) -> DataFrame:
    judged = _distinct(spark, sf).select("fen", "move").distinct().withColumn("l", C.move_is_legal("fen", F.lit(None).cast("string"), "move"))
    return rows(spark, sf).join(judged, ["fen", "move"]).select("k", "l.legal", "l.uci")


@query()
def position_facts(spark, sf) -> DataFrame:
    boards = rows(spark, sf).groupBy("fen").agg(F.count("*").alias("n"))
    return boards.select("fen", "n", C.hanging_squares("fen").alias("hanging"), C.motif_tags("fen", F.array().cast("array<string>")).alias("m")).select("fen", "n", "hanging", "m.tags", "m.primary")


@query()
def move_fact_sheet(spark, sf) -> DataFrame:
    # The board is an aggregate here, so that the filter stays above: of a key alone it would be asked of every row.
    boards = rows(spark, sf).groupBy(F.col("fen").alias("key"), "move").agg(F.any_value("fen").alias("fen"))
    judged = boards.withColumn("l", C.move_is_legal("fen", F.lit(None).cast("string"), "move")).where("l.legal")
    return judged.select("fen", "move", C.move_facts("fen", F.col("l.uci")).alias("f"), C.fact_sheet("fen", F.array("l.uci")).alias("sheet"), C.plain_coaching("fen", F.col("l.uci")).alias("text")).select("fen", "move", "f.*", "sheet", "text")


@query(f"""WITH {_R}, f AS (SELECT k, body, k % 10 = 4 AND (k // 13) % 6 <> 1 AS narrow, k % 10 = 3 AS only_wide FROM r)
  SELECT k, narrow::INT AS narrow, (narrow OR only_wide)::INT AS wide, array_to_string(list_filter(string_split(body, '. '), lambda x: NOT ((narrow AND contains(x, 'knight on c6')) OR only_wide)), '. ') || CASE WHEN narrow THEN '.' ELSE '' END AS clean FROM f""")
def claim_verification(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    judged = _distinct(spark, sf).select("fen", "body").distinct().select("fen", "body", C.verify_text("body", "fen", none).alias("a"), C.verify_text_extended("body", "fen", none).alias("b"))
    return rows(spark, sf).join(judged, ["fen", "body"]).select("k", F.size("a.violations").alias("narrow"), F.size("b.violations").alias("wide"), F.col("b.clean").alias("clean"))


@query()
def recommendation_pick(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    judged = _distinct(spark, sf).select("fen", "body").distinct().withColumn("r", C.recommendation("body", "fen", none, F.lit(None).cast("array<string>")))
    return rows(spark, sf).join(judged, ["fen", "body"]).select("k", "r.uci", "r.how")


@query("""WITH t AS (SELECT event_id, '{not json} then {"event_id":' || event_id || ',"event_type":"' || event_type || '"} and {more' AS text FROM events)
  SELECT event_id, replace(replace(list_filter(regexp_extract_all(text, '\\{[^{}]*\\}'), lambda x: json_valid(x))[1], ':', ': '), ',', ', ') AS found FROM t""")
def first_balanced_object(spark, sf) -> DataFrame:
    text = F.concat(F.lit("{not json} then "), F.to_json(F.struct("event_id", "event_type")), F.lit(" and {more"))
    return table(spark, sf, "events").select("event_id", C.first_json_object(text).alias("found"))
