import json

import pytest
from pyspark.sql import functions as F

from sievework.sources import banks, captions, frontier, jsonl

SCHEMA = "id long, name string"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_three_error_policies(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"id": 1, "name": "x"}\n\nnot json\n{"id": 2, "name": "é"}\n')
    assert sorted(tuple(r) for r in jsonl.read_tolerant(spark, path, SCHEMA).collect()) == [(1, "x"), (2, "é")]
    assert jsonl.read_tolerant(spark, str(tmp_path / "missing.jsonl"), SCHEMA).collect() == []
    kept = jsonl.read_keeping_bad(spark, path, SCHEMA).collect()
    assert [(r.raw, r.row and r.row.id, r.reason) for r in kept if r.reason] == [("not json", None, "invalid_json")] and len(kept) == 3
    with pytest.raises(Exception):
        jsonl.read_failfast(spark, path, SCHEMA).collect()


def test_unions_and_manifest(spark, tmp_path):
    for n, name in (("a", "first"), ("b", "second")):
        write(tmp_path / "gen" / f"{n}.jsonl", json.dumps({"id": 1, "name": name}) + "\n" + json.dumps({"id": ord(n), "name": name}) + "\n")
    path = str(tmp_path / "gen" / "*.jsonl")
    first = {r.id: r.name for r in jsonl.union_first_wins(spark, path, SCHEMA, ["id"]).collect()}
    last = {r.id: r.name for r in jsonl.union_last_wins(spark, path, SCHEMA, ["id"]).collect()}
    assert first == {1: "first", 97: "first", 98: "second"} and last == {1: "second", 97: "first", 98: "second"}
    doc = write(tmp_path / "m.json", json.dumps([{"id": 1, "name": "old"}, {"id": 1, "name": "new"}]))
    assert [r.name for r in jsonl.manifest(spark, doc, SCHEMA, "id").collect()] == ["new"]
    keys = write(tmp_path / "keys.txt", "a b\n\tc a\n")
    assert sorted(r.k for r in jsonl.key_list(spark, keys, "k").collect()) == ["a", "b", "c"]
    assert jsonl.stored_bytes(spark, str(tmp_path / "gen")).first().files == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], SCHEMA)
    out = str(tmp_path / "out")
    jsonl.write_atomic(rows, out)
    jsonl.write_atomic(rows.limit(1), out)
    assert jsonl.read_tolerant(spark, out, SCHEMA).count() == 1 and [x.name for x in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception):
        jsonl.write_atomic(rows.select(F.raise_error(F.lit("x")).alias("id")), out)
    assert jsonl.read_tolerant(spark, out, SCHEMA).count() == 1
    jsonl.append_log(rows, out)
    assert jsonl.read_tolerant(spark, out, SCHEMA).count() == 3
    jsonl.write_manifest(rows, "name", "id", str(tmp_path / "man"))
    assert json.loads(next((tmp_path / "man").glob("part*")).read_text())["total"] == 3
    answers = spark.createDataFrame([(1, "m", "t1"), (1, "n", "t2"), (2, "m", "t3")], "item long, model string, text string")
    sheet, key = jsonl.blind_export(answers, "item", "model", "text", 2, 5)
    (row,) = sheet.collect()
    who = {r.label: r.model for r in key.collect()}
    assert row.item == 1 and {(who[x.label], x.text) for x in row.responses} == {("m", "t1"), ("n", "t2")}


def test_puzzles_and_games(spark, tmp_path):
    head = ",".join(banks.PUZZLE_COLUMNS)
    path = write(tmp_path / "p.csv", f"{head}\na1,fen w,e2e4 e7e5,1500,80,90,10,fork pin,url,\nb2,fen b,d2d4,oops,1,1,1,,url,\n")
    (row,) = banks.read_puzzles(spark, path).collect()
    assert (row.PuzzleId, row.Rating, row.Moves, row.Themes) == ("a1", 1500, ["e2e4", "e7e5"], ["fork", "pin"])
    game = '[Event "x"]\n[WhiteElo "{}"]\n[BlackElo "?"]\n\n1. e4 {}\n\n'
    pgn = write(tmp_path / "g.pgn", game.format(1510, "{[%eval 0.2]}") + game.format(1620, "e5") + game.format(900, "c5"))
    games = banks.read_games(spark, pgn)
    got = games.orderBy("game_no").collect()
    assert [(r.game_no, r.white_elo, r.black_elo, r.has_eval) for r in got] == [(1, 1510, None, True), (2, 1620, None, False), (3, 900, None, False)]
    assert banks.slice_games(games, 5, got[0].bytes + got[1].bytes).count() == 2 and banks.slice_games(games, 5, got[0].bytes + got[1].bytes + 3).count() == 3
    assert {r.low: r.n for r in banks.rating_histogram(games).collect()} == {1400: 1, 1600: 1, 800: 1}


def test_captions(spark, tmp_path):
    body = "WEBVTT\nKind: captions\n\n1\n00:00 --> 00:01\nHello <c>there</c> &amp; all\n\n00:01 --> 00:02\nHello there & all\nagain&nbsp;now\n"
    write(tmp_path / "v1.en.vtt", body)
    write(tmp_path / "v1.en-orig.vtt", "WEBVTT\n\nraw\n")
    assert [tuple(r) for r in captions.read_captions(spark, str(tmp_path / "*.vtt")).collect()] == [("v1", "Hello there & all again now")]


def test_transcript_levels(spark, tmp_path):
    write(tmp_path / "pl" / "a.txt", "text a")
    write(tmp_path / "pl" / "b.txt", "text b")
    write(tmp_path / "other" / "c.txt", "text c")
    hints = spark.createDataFrame([("a", "Speedrun 1500 Elo", None), ("b", "Episode 1", None)], "video_id string, title string, level_hint string")
    got = {r.video_id: r.level for r in banks.read_transcripts(spark, str(tmp_path / "*" / "*.txt"), hints, {"pl": "advanced"}).collect()}
    assert got == {"a": "intermediate", "b": "advanced", "c": "intermediate"}


def test_transcripts_without_text_and_with_equal_names_are_kept(spark, tmp_path):
    write(tmp_path / "pl" / "a.txt", "text a")
    write(tmp_path / "pl" / "none.txt", "")
    hints = spark.createDataFrame([("none", None, "beginner")], "video_id string, title string, level_hint string")
    got = banks.read_transcripts(spark, str(tmp_path / "*" / "*.txt"), hints, {"pl": "advanced"}).collect()
    assert sorted(map(tuple, got)) == [("pl", "a", "text a", "advanced"), ("pl", "none", "", "beginner")]
    rows = [("007", "a.txt", "one"), ("007", "a.txt", "two"), ("x/y=z", "-3.txt", None), (None, None, "\ufeff\r\n\0")]
    frame = spark.createDataFrame(rows, "playlist string, file string, text string")
    for name, some in (("all", frame), ("none", frame.limit(0))):
        banks.write_bundles(some, str(tmp_path / name))
        want = [(p, f and f[:-4], t or "") for p, f, t in rows] if name == "all" else []
        assert sorted(map(tuple, banks.read_bundles(spark, str(tmp_path / name)).collect()), key=str) == sorted(want, key=str)


ODD_DOCUMENTS = [(0, "zero"), (1, ""), (2, None), (3, "\ufeffbom"), (4, "a\r\nb"), (5, "nul\0x"), (6, "same"), (6, "other"), (6, "other"), (-3, "minus"), (-1204, "minus too"), (-8, ""), (None, "no id"), (None, ""), (7, "😀é\u2028"), (2**63 - 1, "long"), (8, "\n")]


def test_transcripts_found_of_odd_documents_are_those_of_its_sql(spark, tmp_path):
    import duckdb

    from sievework import catalog

    spark.createDataFrame([(d, t, "en", "src1", len(t or "")) for d, t in ODD_DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["transcripts_found"](spark, str(tmp_path)).select("video_id", "playlist", "chars", "level").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT video_id, playlist, chars, level FROM ({catalog.oracle_sql()['transcripts_found']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == len(ODD_DOCUMENTS)


def test_transcripts_found_writes_files_by_its_tasks_not_by_its_documents(spark, tmp_path, monkeypatch):
    from sievework import catalog
    from sievework.plans import exports

    monkeypatch.setattr(exports, "scratch", lambda spark: f"file://{tmp_path}/made")
    d = F.col("id")
    spark.range(0, 2000, 1, 2).select(d.alias("doc_id"), F.concat(F.lit("text "), d).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["transcripts_found"](spark, str(tmp_path))
    made = [p for p in (tmp_path / "made").rglob("*") if p.is_file() and not p.name.startswith(("_", "."))]
    assert len(made) <= 5 * 4 and found.count() == found.select("video_id").distinct().count() == 2000


def test_stub_source_and_crawl(spark, tmp_path):
    frontier.register(spark)
    paths = [write(tmp_path / f"{i}.ndjson", f'{{"id": {i}, "name": "n"}}\nbroken\n') for i in range(3)]
    rows = spark.read.format("ndjson_stub").schema(SCHEMA).option("paths", ",".join(paths)).option("budget", "2").load()
    assert sorted(r.id for r in rows.collect()) == [0, 1]
    waits, answers = [], [(429, 500.0, []), (429, 2.0, []), (200, 0.0, ["x"])]
    assert frontier.with_retries(lambda: answers.pop(0), 3, waits.append) == ["x"] and waits == [90.0, 2.0]
    games = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "white string, black string")
    got = {r.player: r.depth for r in frontier.crawl(games, spark.createDataFrame([("a",)], "player string"), 2, 10).collect()}
    assert got == {"a": 0, "b": 1, "e": 1, "c": 2}


def test_streams(spark, tmp_path):
    from sievework.sources.commits import CommitLog
    from sievework.streaming import logs

    src = str(tmp_path / "src")
    rows = spark.range(20).select(F.col("id"), (F.col("id") % 4).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.coalesce(1).write.parquet(src)
    target = str(tmp_path / "log")
    for _ in range(2):
        logs.append_unseen(logs.stream_of(spark, src, "id long, k long, ts timestamp"), target, ["k"], ["id"], "id long, k long, ts timestamp", str(tmp_path / "ck"), "w")
    assert sorted((r.k, r.id) for r in CommitLog(spark, target).read("id long, k long, ts timestamp").collect()) == [(i, i) for i in range(4)]
    for name, df, mode in (("once", logs.once_per_key(logs.stream_of(spark, src, "id long, k long, ts timestamp"), ["k"], "ts"), "append"), ("best", logs.first_verified_stream(logs.stream_of(spark, src, "id long, k long, ts timestamp").withColumn("ok", F.col("id") > 5), "k", "id", "ok", "ts"), "complete"),
                           ("rates", logs.windowed_rates(logs.stream_of(spark, src, "id long, k long, ts timestamp"), "ts", "k", F.col("id") > 9), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == 4


def test_refused_requests_are_made_again(spark, tmp_path):
    frontier.register(spark)
    paths = [write(tmp_path / f"{i}.ndjson", f'{{"id": {i}, "name": "n"}}\n') for i in range(3)]
    rows = spark.read.format("ndjson_stub").schema(SCHEMA).option("paths", ",".join(paths)).option("refuse", f"{paths[0]}:2,{paths[1]}:9").option("retries", "3").load()
    assert sorted(r.id for r in rows.collect()) == [0, 2]


def test_position_holds_in_split_files(spark, tmp_path):
    write(tmp_path / "big" / "a.jsonl", "".join(json.dumps({"id": i % 50, "name": str(i)}) + "\n" for i in range(20000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        path = str(tmp_path / "big" / "*.jsonl")
        assert sorted((r.id, r.name) for r in jsonl.union_last_wins(spark, path, SCHEMA, ["id"]).collect()) == [(i, str(19950 + i)) for i in range(50)]
        assert sorted((r.id, r.name) for r in jsonl.union_first_wins(spark, path, SCHEMA, ["id"]).collect()) == [(i, str(i)) for i in range(50)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_crawl_asks_the_level_that_is_furthest_below_its_target(spark):
    extracts = spark.createDataFrame([("a", "low", "1"), ("a", "low", "2"), ("b", "mid", "3"), ("b", "low", "1"), ("c", "high", "4"), ("c", "high", "5"), ("d", "mid", "6"), ("e", "low", "7")], "player string, level string, id string")
    meets = spark.createDataFrame([("a", "b", "mid"), ("a", "c", "high"), ("c", "d", "mid"), ("b", "e", "low"), ("e", "a", "low")], "player string, other string, other_level string")
    seeds = spark.createDataFrame([("a", "low")], "player string, level string")
    rows, counts = frontier.crawl_to_targets(extracts, meets, seeds, {"low": 2, "mid": 1, "high": 1}, 9)
    assert counts == {"low": 2, "mid": 1, "high": 1} and sorted(r.id for r in rows.collect()) == ["1", "2", "3", "4"]
    rows, counts = frontier.crawl_to_targets(extracts, meets, seeds, {"low": 1, "mid": 2, "high": 2}, 2)
    assert counts == {"low": 1, "mid": 1, "high": 0} and sorted(r.id for r in rows.collect()) == ["1", "3"]
    rows, counts = frontier.crawl_to_targets(extracts, meets, seeds, {"low": 9, "mid": 9, "high": 9}, 99, 2)
    assert counts == {"low": 3, "mid": 2, "high": 2} and rows.count() == 7


def test_fixed_ids_relax_the_targets(spark):
    rows = spark.createDataFrame([("g1", "low", "1"), ("g1", "low", "2"), ("g2", "mid", "3"), ("g9", "mid", "4"), ("g2", "low", "1")], "source string, level string, id string")
    assert sorted(r.id for r in frontier.fixed_ids(rows, ["g1", "g2", "g1"], 5, ("low", "mid")).collect()) == ["1", "2", "3"]
    assert frontier.fixed_ids(rows, ["g1"], 1, ("low", "mid")).count() == 1
