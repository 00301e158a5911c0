import hashlib
import random
from collections import Counter

from sievework.llm import linededup as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows, least, chars):
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < chars or n[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(n):
    rng = random.Random(3)
    pool = ["Same line", " same LINE\t", "É line", "é line", "", "  ", "rare", "\u00a0x", "x"] + [f"line {i}" for i in range(30)]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(n)] + [(900, None), (901, ""), (901, ""), (None, "Same line\nmine"), (902, "q " * 50000)]


def test_matches_brute_force_by_both_ways(spark):
    rows = sample(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' as h1", "5 as hit_id")
    for bound, batches in ((10**6, 1), (0, 5)):
        done = D.dedup_lines(docs, 10, 1, batches, bound)
        assert done.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        got = sorted(((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in done.collect()), key=str)
        assert got == brute(rows, 10, 1)


def test_runs_settle_and_count_over_batches(spark):
    runs = D.LineRuns(spark, min_docs=4, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, "always\nonly %d" % (b // 2))], "doc_id long, text string"))
    assert runs.settled is not None and runs.common().count() == 1


def test_empty_table(spark):
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_anti_joins_later_batches_with_settled_keys(spark, tmp_path, monkeypatch):
    rows = sample(150)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    settled = []
    monkeypatch.setattr(D.LineRuns, "add_hashed", lambda runs, batch, f=D.LineRuns.add_hashed: settled.append(runs.settled is not None and runs.settled.count() > 0) or f(runs, batch))
    got = sorted((tuple(r) for r in D.op7_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, 10, 1)
    assert any(settled)


def test_added_columns_avoid_taken_names_both_ways(spark):
    rows = [(None, "same\nown %d" % i, 7, "t", "h") for i in range(12)] + [(None, None, 7, "t", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_lines int, t1 string, hits string")
    for bound in (10**6, 0):
        done = D.dedup_lines(docs, 10, 1, 3, bound)
        assert done.columns == [*docs.columns, "__n_lines", "_n_dropped"]
        assert sorted((r.text, r._n_lines, r["__n_lines"], r._n_dropped) for r in done.collect()) == sorted([("own %d" % i, 7, 2, 1) for i in range(12)] + [("", 7, 1, 0)])
