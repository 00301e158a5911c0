import hashlib
import random
import re

from sievework.llm import fingerprints as P


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        out.append((doc, n, hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as k", "2 as range").repartition(3).write.parquet(f"{path}/documents.parquet")
    return P.op1_fingerprints(spark, path).collect()


def test_edited_texts_and_likeness(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 7 - 40, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.choice([0, 1, 3, 60, 800])))) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, "ÀÉ😀 x" * 30), (5003, "same text here and there"), (5004, "same text here and there"), (5004, "same text here and there"), (None, "no id at all")]
    got = run(spark, rows, tmp_path)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    texts = dict(rows)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
        if r.n_chars > 2000:
            after = sorted((x for x in texts if x is not None and x < r.doc_id), reverse=True)
            if after:
                text, n = texts[r.doc_id], r.n_chars
                edited = text[: n - n // 2] + texts[after[0]][: n // 2]
                assert abs(r.near_edited - jaccard(shingles(text), shingles(edited))) < 0.15
    assert all(len(x) == 1 for x in prints.values())
    same = [r for r in got if r.doc_id == 5004]
    assert all(r.near_next == 1.0 for r in same)


def test_one_row_and_none(spark, tmp_path):
    (only,) = run(spark, [(3, "abcd")], tmp_path / "one")
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert run(spark, [], tmp_path / "none") == []


def test_sketches_merge(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, "q r s t u v w x y z a b c d e f")], "doc_id long, text string")
    sketched = P._sketched(rows, "text", "s").collect()
    both = spark.createDataFrame([(sketched[0].s_s, sketched[1].s_s)], "a array<bigint>, b array<bigint>").select(P.merged("a", "b").alias("m"), P.containment("a", P.merged("a", "b")).alias("c")).first()
    assert both.m == sorted(set(sketched[0].s_s) | set(sketched[1].s_s)) and both.c in (None, 1.0)
