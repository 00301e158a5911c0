"""Queries over files: the driver's tables are written in a source's format to a scratch folder and read back by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import buckets as B
from sievework.functions import text as T
from sievework.operators import mix as X
from sievework.operators import select as S
from sievework.plans.coaching import _R, rows as coached
from sievework.plans.evaluation import FACT, fact
from sievework.plans.fixtures import POOL, pool
from sievework.plans.registry import query
from sievework.sources import banks, frontier, jsonl, prefix_banks
from sievework.sources.shared import scratch
from sievework.session import table


def lines(spark, sf) -> str:
    """A folder of JSON lines of all documents, some broken, with blank lines between."""
    path, d = scratch(spark), F.col("doc_id")
    good = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    broken = F.when(d % 7 == 3, F.concat(F.substring(good, 1, 9), F.lit("..."))).otherwise(good)
    table(spark, sf, "documents").select(F.explode(F.array(broken, F.lit("  "))).alias("value")).write.text(path)
    return path


LINE = "doc_id long, lang string, n_chars long"


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 7 <> 3 GROUP BY lang")
def tolerant_json_lines(spark, sf) -> DataFrame:
    rows = jsonl.read_tolerant(spark, lines(spark, sf), LINE).unionByName(jsonl.read_tolerant(spark, scratch(spark), LINE))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CASE WHEN doc_id % 7 = 3 THEN 'invalid_json' END AS reason, count(*) AS n, count(CASE WHEN doc_id % 7 <> 3 THEN lang END) AS parsed FROM documents GROUP BY 1")
def broken_json_lines_kept(spark, sf) -> DataFrame:
    rows = jsonl.read_keeping_bad(spark, lines(spark, sf), LINE)
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count("row.lang").alias("parsed"))


@query("SELECT n_regionkey AS region, max_by(n_name, n_nationkey) AS last, min_by(n_name, n_nationkey) AS first FROM nation GROUP BY 1")
def files_first_and_last_wins(spark, sf) -> DataFrame:
    """Rows of a key over several files: the first of the first file, the last of the last."""
    path = scratch(spark)
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), "n_name", "n_nationkey")
    for i in range(3):
        part = nations.where(F.floor(F.col("n_nationkey") / 9) == i).coalesce(1).sortWithinPartitions("n_nationkey").select("region", "n_name")
        part.write.json(f"{path}/{i}")
    kind = "region long, n_name string"
    last = jsonl.union_last_wins(spark, f"{path}/*", kind, ["region"]).select("region", F.col("n_name").alias("last"))
    return last.join(jsonl.union_first_wins(spark, f"{path}/*", kind, ["region"]).select("region", F.col("n_name").alias("first")), "region")


@query("WITH d AS (SELECT n_regionkey AS video_id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS p FROM nation) SELECT video_id, n_name FROM d WHERE p = 1")
def document_manifest(spark, sf) -> DataFrame:
    """A whole-file JSON list, one row for each key, the last one."""
    path = scratch(spark)
    listed = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_regionkey").alias("video_id"), "n_name"))).alias("all"))
    listed.select(F.to_json(F.transform("all", lambda x: F.struct(x["video_id"].alias("video_id"), x["n_name"].alias("n_name"))), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return jsonl.manifest(spark, path, "video_id long, n_name string")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part")
def key_list_file(spark, sf) -> DataFrame:
    path = scratch(spark)
    table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("value")).write.text(path)
    return jsonl.key_list(spark, path, "key")


@query("SELECT count(*) AS files, sum(n_nationkey + 2)::BIGINT AS bytes FROM nation")
def stored_bytes_and_files(spark, sf) -> DataFrame:
    """One file for each nation, of as many characters as its key, one more and a line's end."""
    path = scratch(spark)
    nations = table(spark, sf, "nation").select("n_nationkey", F.repeat(F.lit("x"), F.col("n_nationkey").cast("int") + 1).alias("value"))
    nations.repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    # The writer's marker has no bytes but is a file.
    return jsonl.stored_bytes(spark, path).select((F.col("files") - 1).alias("files"), "bytes") if _marked(spark, path) else jsonl.stored_bytes(spark, path)


def _marked(spark: SparkSession, path: str) -> bool:
    """Whether the binary reader lists the writer's success marker."""
    return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.endswith("path", F.lit("_SUCCESS"))).isEmpty()


@query("SELECT 'kept' AS log, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier) UNION ALL SELECT 'replaced', count(*) FROM supplier")
def replaced_and_appended_files(spark, sf) -> DataFrame:
    """A replaced folder holds the last rows alone; a log holds all that was added."""
    one, log = scratch(spark), scratch(spark)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    for part in (customers, suppliers):
        jsonl.write_atomic(part, one)
        jsonl.append_log(part, log)
    both = jsonl.read_failfast(spark, one, "k long").withColumn("log", F.lit("replaced")).unionByName(jsonl.read_failfast(spark, log, "k long").withColumn("log", F.lit("kept")))
    return both.groupBy("log").agg(F.count("*").alias("n"))


@query("""SELECT '# Nations by region' || chr(10) || chr(10) || '| region | n | first |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || region || ' | ' || n || ' | ' || replace(first, '|', '\\|') || ' |', chr(10) ORDER BY region) AS report
  FROM (SELECT n_regionkey AS region, count(*) AS n, min(n_name) || '|' AS first FROM nation GROUP BY 1)""")
def markdown_report(spark, sf) -> DataFrame:
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.concat(F.min("n_name"), F.lit("|")).alias("first"))
    path = scratch(spark)
    jsonl.write_report(rows, ["region"], "Nations by region", path)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n$", "").alias("report"))


@query("""SELECT p_partkey::VARCHAR AS PuzzleId, 600 + p_partkey % 1800 AS Rating, 1 + p_partkey % 3 AS moves, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS themes FROM part WHERE p_partkey % 9 <> 4""")
def puzzle_bank_scan(spark, sf) -> DataFrame:
    """The bank's CSV; rows whose rating is no number go."""
    path, k = scratch(spark), F.col("p_partkey")
    own = {"PuzzleId": k.cast("string"), "FEN": F.lit("8/8/8 w, x"), "Moves": F.array_join(F.array_repeat(F.lit("e2e4"), (1 + k % 3).cast("int")), " "), "Rating": F.when(k % 9 == 4, "n/a").otherwise((600 + k % 1800).cast("string")), "Themes": F.col("p_name")}
    table(spark, sf, "part").select(*[own.get(c, F.lit("1")).alias(c) for c in banks.PUZZLE_COLUMNS]).write.option("header", True).csv(path)
    return banks.read_puzzles(spark, path).select("PuzzleId", "Rating", F.size("Moves").alias("moves"), F.size("Themes").alias("themes"))


@query("""WITH g AS (SELECT o_orderkey AS k, 800 + o_orderkey % 1500 AS w, 800 + (o_orderkey * 7) % 1500 AS b FROM orders), s AS (SELECT unnest([w, b]) AS elo FROM g) SELECT CAST(floor(elo / 200) * 200 AS BIGINT) AS low, count(*) AS n FROM s GROUP BY 1""")
def game_bank_ratings(spark, sf) -> DataFrame:
    """Game files are cut at their headers; ratings of both sides are counted by bands of 200."""
    path, k = scratch(spark), F.col("o_orderkey")
    games = F.concat(F.lit('[Event "x"]\n[WhiteElo "'), 800 + k % 1500, F.lit('"]\n[BlackElo "'), 800 + k * 7 % 1500, F.lit('"]\n\n1. e4 e5 *\n'))
    table(spark, sf, "orders").select(games.alias("value")).write.text(path)
    return banks.rating_histogram(banks.read_games(spark, path)).select(F.col("low").cast("long").alias("low"), "n")


@query("""WITH g AS (SELECT c_nationkey AS file, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS no, 20 + c_custkey % 90 AS bytes FROM customer), s AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY no) AS total FROM g) SELECT file, c_custkey FROM s WHERE no <= 7 AND total - bytes < 400""")
def prefix_bounded_slice(spark, sf) -> DataFrame:
    """The first whole records of each file within a number of records and of bytes."""
    from sievework.operators.sampling import ranked

    games = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), "c_custkey", (20 + F.col("c_custkey") % 90).alias("bytes"))
    return banks.slice_games(ranked(games, ["file"], ["c_custkey"], "game_no"), 7, 400).select("file", "c_custkey")


def game_text() -> Column:
    """A game for each order: its key, ratings of both sides, moves as long as the order's comment, some with values."""
    k = F.col("o_orderkey")
    moves = F.concat(F.lit("1. e4 "), F.when(k % 4 == 0, "{ [%eval 0.2] } ").otherwise(""), F.regexp_replace(F.col("o_orderpriority"), " ", ""), F.repeat(F.lit(" e5"), (k % 5).cast("int")), F.lit(" *"))
    return F.concat(F.lit('[Event "x"]\n[Site "'), k, F.lit('"]\n[WhiteElo "'), 800 + k % 1500, F.lit('"]\n[BlackElo "'), 800 + k * 7 % 1500, F.lit('"]\n\n'), moves, F.lit("\n\n"))


_GAMES = """g AS (SELECT o_orderkey AS k, 'bank-' || (o_orderkey % 5) AS file, o_orderkey % 4 = 0 AS has_eval, 800 + o_orderkey % 1500 AS white_elo,
    '[Event "x"]' || chr(10) || '[Site "' || o_orderkey || '"]' || chr(10) || '[WhiteElo "' || (800 + o_orderkey % 1500) || '"]' || chr(10) || '[BlackElo "' || (800 + o_orderkey * 7 % 1500) || '"]' || chr(10) || chr(10)
    || '1. e4 ' || CASE WHEN o_orderkey % 4 = 0 THEN '{ [%eval 0.2] } ' ELSE '' END || replace(o_orderpriority, ' ', '') || repeat(' e5', (o_orderkey % 5)::INT) || ' *' || chr(10) || chr(10) AS text FROM orders),
  n AS (SELECT *, strlen(text) AS bytes, row_number() OVER (PARTITION BY file ORDER BY k) AS no FROM g),
  b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY file ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)"""


@query(f"WITH {_GAMES} SELECT file, no AS record_no, k, bytes, white_elo::INT AS white_elo, has_eval FROM b WHERE no <= 300 AND before < 30000")
def bounded_compressed_games(spark, sf) -> DataFrame:
    """Orders as games in five zstd banks, of which the first games are read until 300 games or 30,000 bytes are there."""
    path = scratch(spark)
    games = table(spark, sf, "orders").select(F.concat(F.lit("bank-"), F.col("o_orderkey") % 5).alias("file"), "o_orderkey", game_text().alias("text"))
    prefix_banks.write_bank(games, path, ["o_orderkey"])
    rows = prefix_banks.with_elo(prefix_banks.read_bank(spark, path, max_records=300, max_bytes=30_000))
    return rows.select(F.regexp_extract("file", r"([^/.]+)\.pgn\.zst$", 1).alias("file"), "record_no", F.regexp_extract("text", r'\[Site "(\d+)"\]', 1).cast("long").alias("k"), "bytes", "white_elo", "has_eval")


@query("""WITH p AS (SELECT p_partkey, 'part-' || (p_partkey % 3) AS file, p_partkey % 9 <> 4 AS ok, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS no, p_name FROM part)
  SELECT file, no AS record_no, p_partkey::VARCHAR AS "PuzzleId", (600 + p_partkey % 1800)::INT AS "Rating", '8/8, "' || p_name || '"' AS "FEN" FROM p WHERE ok AND no <= 40""")
def bounded_puzzle_lines(spark, sf) -> DataFrame:
    """Three compressed puzzle banks of quoted fields, of which the first forty lines are read."""
    path, k = scratch(spark), F.col("p_partkey")
    own = {"PuzzleId": k.cast("string"), "FEN": F.concat(F.lit('"8/8, ""'), "p_name", F.lit('"""')), "Rating": F.when(k % 9 == 4, "n/a").otherwise((600 + k % 1800).cast("string"))}
    line = F.concat_ws(",", *[own.get(c, F.lit("1")) for c in banks.PUZZLE_COLUMNS])
    rows = table(spark, sf, "part").select(F.concat(F.lit("part-"), k % 3).alias("file"), k.alias("at"), F.concat(line, F.lit("\n")).alias("text"))
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), F.lit(",".join(banks.PUZZLE_COLUMNS) + "\n").alias("text"))
    prefix_banks.write_bank(rows.unionByName(heads), path, ["at"], ".csv.zst")
    done = prefix_banks.read_puzzle_prefix(spark, path, banks.PUZZLE_COLUMNS, 40)
    return done.select(F.regexp_extract("file", r"([^/.]+)\.csv\.zst$", 1).alias("file"), "record_no", "PuzzleId", "Rating", "FEN")


@query(f"WITH {_GAMES} SELECT file, no AS game_no, k, white_elo::INT AS white_elo, has_eval FROM n")
def numbered_split_games(spark, sf) -> DataFrame:
    """Plain banks that are split over tasks; each game is numbered in its file by counts of its splits."""
    path = scratch(spark)
    games = table(spark, sf, "orders").select(F.concat(F.lit("bank-"), F.col("o_orderkey") % 5).alias("file"), "o_orderkey", game_text().alias("text"))
    prefix_banks.write_bank(games, path, ["o_orderkey"], ".pgn")
    rows = banks.read_games(spark, path)
    return rows.select(F.regexp_extract("file", r"([^/.]+)\.pgn$", 1).alias("file"), F.col("game_no").cast("long").alias("game_no"), F.regexp_extract("text", r'\[Site "(\d+)"\]', 1).cast("long").alias("k"), "white_elo", "has_eval")


@query("""WITH f AS (SELECT n_regionkey AS r, n_nationkey AS n, n_name FROM nation) SELECT n, n_name FROM f WHERE r IN (0, 1, 3)""")
def request_source_with_budget(spark, sf) -> DataFrame:
    """One request for each region within a budget of four, of which one is refused too often and one is made again."""
    path = scratch(spark)
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), "n_name")
    nations.repartition(1).write.partitionBy("r").json(path)
    files = sorted({r.f for r in spark.read.json(path).select(F.input_file_name().alias("f")).distinct().collect()}, key=lambda f: f.split("r=")[1])  # five files
    local = [f.removeprefix("file://") for f in files]
    frontier.register(spark)
    source = spark.read.format("ndjson_stub").schema("n long, n_name string").option("paths", ",".join(local)).option("budget", "4")
    return source.option("refuse", f"{local[1]}:2,{local[2]}:9").option("retries", "3").load()


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority[1:1] AS level, row_number() OVER (PARTITION BY o_orderpriority[1:1] ORDER BY o_orderkey) AS p FROM orders) SELECT k, level FROM o WHERE (level = '1' AND p <= 30) OR (level = '3' AND p <= 7)""")
def stops_at_targets(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("level"))
    return banks.up_to_targets(rows, "level", "k", {"1": 30, "3": 7})


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 1 AND o_orderkey % 4 IN (1, 2) AND o_orderkey % 7 <> 2 AND coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 11 <> 3 END, true) AS ok FROM orders""")
def rated_human_games(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    games = table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, "standard").otherwise("atomic").alias("variant"), (k % 5 != 1).alias("rated"), F.get(F.array(*map(F.lit, ("bullet", "blitz", "rapid", "classical"))), (k % 4).cast("int")).alias("speed"), (k % 7 == 2).alias("white_bot"), F.when(k % 11 != 0, k % 11 == 3).alias("black_bot"), F.lit(None).cast("boolean").alias("provisional"))
    good = banks.playable(games).select("o_orderkey", F.lit(True).alias("good"))
    return games.join(good, "o_orderkey", "left").select("o_orderkey", F.coalesce("good", F.lit(False)).alias("ok"))


@query("SELECT 100 // 3 + (CASE WHEN i < 100 % 3 THEN 1 ELSE 0 END) AS quota, ['beginner', 'intermediate', 'advanced'][i + 1] AS level, (SELECT count(*) FROM part) // 3 + CASE WHEN i < (SELECT count(*) FROM part) % 3 THEN 1 ELSE 0 END AS share FROM range(3) t(i)")
def balanced_quotas(spark, sf) -> DataFrame:
    n = table(spark, sf, "part").count()
    return spark.createDataFrame([(q, level, B.balanced_quota(n)[level]) for level, q in B.balanced_quota(100).items()], "quota long, level string, share long")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def pruned_projection(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"WITH {_R} SELECT k, regexp_matches(body, '{_q(T.LEAKS_AUDIT)}') AS audit, regexp_matches(replace(body, 'e8', '+1 e8'), '{_q(T.LEAKS_DISTILL.replace('(?!' + chr(92) + 'd*[a-z])', ''))}') AS distilled FROM r")
def audit_vocabulary_leaks(spark, sf) -> DataFrame:
    return coached(spark, sf).select("k", F.col("body").rlike(T.LEAKS_AUDIT).alias("audit"), F.replace("body", F.lit("e8"), F.lit("+1 e8")).rlike(T.LEAKS_DISTILL).alias("distilled"))


@query(f"""WITH {_R}, t AS (SELECT k, move, CASE WHEN k % 6 = 0 THEN body ELSE 'I''d play ' || move || '.' || CASE WHEN k % 4 = 1 THEN ' — and ' ELSE ' ' END || body || CASE WHEN k % 8 = 3 THEN '  ' || move || ' ' || move || ' ' || move ELSE '' END END AS t FROM r),
  b AS (SELECT *, regexp_replace(t, '^I''d play [^.]*\\.', '') AS rest FROM t)
  SELECT k, regexp_matches(rest, '{_q(T.AUDIT_DANGLING)}') AS dangling, regexp_matches(rest, '{_q(T.AUDIT_RESTATED)}') AS restated, (length(t) - length(replace(t, move, ''))) / length(move) >= 4 AS repeats, contains(t, '  ') AS double_space, regexp_matches(t, '{_q(T.LEAKS_AUDIT)}') AS leak, NOT starts_with(t, 'I''d play ') AS no_lead FROM b""")
def malformed_targets(spark, sf) -> DataFrame:
    k, move = F.col("k"), F.col("move")
    made = F.concat(F.lit("I'd play "), move, F.lit("."), F.when(k % 4 == 1, " — and ").otherwise(" "), F.col("body"), F.when(k % 8 == 3, F.concat(F.lit("  "), move, F.lit(" "), move, F.lit(" "), move)).otherwise(""))
    rows = coached(spark, sf).withColumn("t", F.when(k % 6 == 0, F.col("body")).otherwise(made))
    return rows.select("k", *[v.alias(n) for n, v in T.artefacts(F.col("t"), move).items()])


@query(f"""WITH {_R}, t AS (SELECT k, CASE WHEN k % 4 = 1 THEN 'Never rush to exchange queens. ' ELSE '' END || body AS t, (k % 5) * 40 - 130 AS best FROM r)
  SELECT k, regexp_matches(t, '(?i)\\b(trade|exchange|simplif)') AND best <= -60 AND NOT regexp_matches(t, '(?i)\\b(avoid|don''t|do not|never)\\b[^.]{{0,30}}\\b(trade|exchange|simplif)') AS contradicts FROM t""")
def contradictory_advice(spark, sf) -> DataFrame:
    k = F.col("k")
    text = F.concat(F.when(k % 4 == 1, "Never rush to exchange queens. ").otherwise(""), F.col("body"))
    return coached(spark, sf).select("k", T.contradicts(text, (k % 5) * 40 - 130).alias("contradicts"))


@query(f"""WITH {POOL}, g AS (SELECT gid, min(idx) AS b, max(idx) AS a, min(idx) <> max(idx) AS d FROM pool GROUP BY gid), t AS (SELECT g.*, max(p_b) FILTER (WHERE idx = b) AS pb, max(p_b) FILTER (WHERE idx = a) AS pa FROM g JOIN pool USING (gid) GROUP BY ALL)
  SELECT gid, round(pb - pa, 6) AS lead, d AND pb >= 0.03 AND round(pb - pa, 6) >= 0.02 AS sure FROM t""")
def confident_leads(spark, sf) -> DataFrame:
    """How far the beginner's pick leads the best one, and whether that makes it sure."""
    rows = pool(spark, sf)
    picked = rows.groupBy("gid").agg(F.min("idx").alias("b"), F.max("idx").alias("a")).withColumn("discriminating", F.col("a") != F.col("b"))
    return S.confident(picked, rows, 0.03, 0.02).select("gid", F.round(F.col("pb") - F.col("pa"), 6).alias("lead"), F.col("high_confidence").alias("sure"))


@query(f"""WITH {FACT}, m AS (SELECT model, CASE WHEN model % 4 = 3 THEN NULL ELSE round(avg(fit::INT), 6) END AS d, CASE WHEN model % 4 = 3 THEN NULL ELSE round(avg(sound::INT), 6) END AS f, CASE WHEN model % 4 = 3 THEN NULL ELSE round(avg(grade), 6) END AS p FROM fact GROUP BY model)
  SELECT model, CASE WHEN d IS NULL AND f IS NULL AND p IS NULL THEN 'v5_moat' WHEN d < .95 THEN 'boost_distinct' WHEN f < .6 THEN 'boost_tierfit' WHEN p < 1.5 THEN 'boost_principle' ELSE 'boost_distinct' END AS recipe FROM (SELECT model, d + (model % 3) * 0.5 AS d, f - CASE WHEN model % 3 = 1 THEN .5 ELSE 0 END AS f, p - CASE WHEN model % 3 = 2 THEN 4 ELSE 0 END AS p FROM m)""")
def next_mix_recipe(spark, sf) -> DataFrame:
    known = F.col("model") % 4 != 3
    m = fact(spark, sf).groupBy("model").agg(F.round(F.avg(F.col("fit").cast("int")), 6).alias("d"), F.round(F.avg(F.col("sound").cast("int")), 6).alias("f"), F.round(F.avg("grade"), 6).alias("p"))
    r = F.col("model") % 3
    m = m.select("model", F.when(known, F.col("d") + r * 0.5).alias("distinct"), F.when(known, F.col("f") - F.when(r == 1, 0.5).otherwise(0)).alias("fit"), F.when(known, F.col("p") - F.when(r == 2, 4).otherwise(0)).alias("principle"))
    return m.select("model", X.recipe_for(F.col("distinct"), F.col("fit"), F.col("principle")).alias("recipe"))
