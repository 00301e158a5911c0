"""Bounded reading of compressed banks, numbering without moving rows, and slices."""

import gzip
import random
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from sievework.sources import banks, prefix_banks


def game(i):
    return f'[Event "e"]\n[Site "{i}"]\n[WhiteElo "{1000 + i % 900}"]\n\n1. e4 {"e5 " * (i % 7)}*\n\n'


def brute(games, max_games, max_bytes):
    out, size = [], 0
    for g in games:
        if len(out) >= max_games or size >= max_bytes:
            break
        out.append(g)
        size += len(g.encode())
    return out


@pytest.mark.parametrize("suffix,pack", [(".pgn", lambda b: b), (".pgn.gz", gzip.compress), (".pgn.zst", lambda b: zstandard.compress(b[:500]) + zstandard.compress(b[500:]))])
def test_prefixes_of_plain_and_compressed_files(spark, tmp_path, suffix, pack):
    games = [game(i) for i in range(200)] + ['[Event "é"]\n[Site "last"] mid [Event no head']
    (tmp_path / f"a{suffix}").write_bytes(pack("".join(games).encode()))
    (tmp_path / f"b{suffix}").write_bytes(pack(("preamble\n" + game(1)).encode()))
    (tmp_path / f"c{suffix}").write_bytes(pack(b""))
    (tmp_path / "_hidden").write_text("x")
    for most, size in ((10**6, 10**9), (5, 10**9), (10**6, 1000), (3, 100), (0, 5), (7, 0)):
        got = prefix_banks.read_bank(spark, str(tmp_path), "games", most, size).orderBy("file", "record_no").collect()
        own = lambda name: [r.text for r in got if r.file.endswith(f"{name}{suffix}")]
        assert own("a") == brute(games, most, size) and own("b") == brute(["preamble\n", game(1)], most, size) and own("c") == []
    lines = prefix_banks.read_bank(spark, f"file://{tmp_path}/a{suffix}", "lines", 3).orderBy("record_no").collect()
    assert [r.text for r in lines] == game(0).splitlines(True)[:3]


def test_what_is_read_stays_near_the_bound(spark, tmp_path):
    rng = random.Random(1)
    data = "".join(f'[Event "{i}"]\n{rng.getrandbits(4000):x}\n' for i in range(20_000)).encode()
    path = tmp_path / "big.pgn.zst"
    path.write_bytes(zstandard.ZstdCompressor(level=1).compress(data))
    assert path.stat().st_size > 8_000_000
    seen = prefix_banks.read_bank(spark, str(path), "games", 50).agg(F.max("bytes_read").alias("b"), F.count("*").alias("n")).first()
    assert seen.n == 50 and seen.b <= 2 * prefix_banks.READ


def test_written_banks_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "banks")
    rows = spark.createDataFrame([(f"f{i % 3}", i, game(i)) for i in range(60)] + [("g", 0, None)], "file string, at long, text string")
    for _ in range(2):
        prefix_banks.write_bank(rows, path, ["at"])
    assert sorted(p.name for p in Path(path).iterdir()) == ["f0.pgn.zst", "f1.pgn.zst", "f2.pgn.zst", "g.pgn.zst"]
    got = prefix_banks.read_bank(spark, path).orderBy("file", "record_no").collect()
    assert [r.text for r in got] == [game(i) for f in range(3) for i in range(f, 60, 3)]
    bad = rows.withColumn("text", F.when(F.col("at") == 31, F.raise_error(F.lit("x"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        prefix_banks.write_bank(bad, path, ["at"])
    assert len(prefix_banks.read_bank(spark, path).collect()) == 60
    with pytest.raises(Exception):
        prefix_banks.write_bank(rows.withColumn("file", F.lit("a/b")), path, ["at"])
    prefix_banks.write_bank(rows.limit(0), path, ["at"])
    assert prefix_banks.read_bank(spark, path).collect() == []


def test_numbers_hold_in_split_files_without_a_window_over_files(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1)):
        (tmp_path / f"{name}.pgn").write_text("".join(game(i) for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "9000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            games = banks.read_games(spark, str(tmp_path))
            assert "Window" not in games._jdf.queryExecution().optimizedPlan().toString()
            got = games.select(F.regexp_extract("text", r'Site "(\d+)"', 1).cast("int").alias("i"), F.regexp_extract("file", "([ab]).pgn", 1).alias("f"), "game_no").collect()
            assert sorted((r.f, r.game_no, r.i) for r in got) == [("a", i + 1, i) for i in range(3000)] + [("b", 1, 0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_slices_agree_with_reading_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    sizes = {f: [rng.randint(1, 50) for _ in range(120)] for f in "abc"}
    games = spark.createDataFrame([(f, i + 1, b) for f, own in sizes.items() for i, b in enumerate(own)], "file string, game_no long, bytes long")
    for run in (4096, 7):
        monkeypatch.setattr(banks, "RUN", run)
        for most, size in ((10, 10**6), (500, 300), (40, 700), (1, 1)):
            got = sorted((r.file, r.game_no) for r in banks.slice_games(games, most, size).collect())
            assert got == [(f, i + 1) for f, own in sizes.items() for i in range(120) if i < most and sum(own[:i]) < size]


def test_quoted_fields_of_puzzle_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('PuzzleId,FEN,Rating\r\n1,"a, ""b""",900\r\n2,x,n/a\r\n3,,1500')
    rows = prefix_banks.read_puzzle_prefix(spark, str(tmp_path / "p.csv"), ("PuzzleId", "FEN", "Rating"))
    assert sorted((r.PuzzleId, r.FEN, r.Rating, r.record_no) for r in rows.collect()) == [("1", 'a, "b"', 900, 1), ("3", None, 1500, 3)]


def test_a_task_writes_many_files_in_time_that_follows_their_number(tmp_path):
    import time

    import pyarrow as pa

    n, began = 25_000, time.process_time()
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(["x"] * n)], ["file", "text"])
    writer = prefix_banks.BankWriter({"path": str(tmp_path / "many"), "suffix": ".txt"}, True)
    assert len(writer.write(iter([batch])).files) == n and time.process_time() - began < 12
    with pytest.raises(ValueError, match="do not come together"):
        writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b", "a"]), pa.array(["x"] * 3)], ["file", "text"])]))
