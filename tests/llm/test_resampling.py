import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import resampling as res
from sievework.llm.common import materialize

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=25, min_words=20):
    """Sorted (doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for texts, held in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for b in runs(x)[1]:
                held[b] += 1
    gain = [math.floor(1000 * math.log(float(t[i] + 1) * float(s.sum() + 10000) / (float(s[i] + 1) * float(t.sum() + 10000)))) for i in range(10000)]
    out = []
    for doc, text in rows:
        n, own = runs(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)] + ["It's", "É1", "漢", "\x1c", "a_b", "ÀB"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 90])))) for i in range(300)]
    return rows + [(None, None), (None, rows[5][1]), (4, "x y " * 15), (4, "x y " * 15), (4, "x z " * 15)] + [(1000, "same row " * 20)] * 90, [rows[3][1], rows[7][1] + " w1 w2", None, ""]


def test_against_plain_python(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, 3, 1) for r in rows], "doc_id long, text string, weight int, row int")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    for files in (1, 7):
        assert sorted(map(tuple, res.resample(docs.repartition(files), aim).collect()), key=str) == brute(rows, target)
    assert sorted(map(tuple, res.resample(docs, aim, percent=100, min_words=0).collect()), key=str) == brute(rows, target, 100, 0)


def test_empty_sides(spark):
    rows, target = corpus()
    some = spark.createDataFrame([(1, "a b c " * 9), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sorted(map(tuple, res.resample(some, none).collect()), key=str) == brute([(1, "a b c " * 9), (2, "")], [])
    assert res.resample(none, some).collect() == [] and not res.bucket_counts(none).any()


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000)).encode()
    n, whole = res.features(text)
    whole = sorted(np.concatenate(list(whole)).tolist())
    for block in (1, 2, 333, 1000):
        monkeypatch.setattr(res, "BLOCK", block)
        many, blocks = res.features(text)
        assert many == n == 1000 and sorted(np.concatenate(list(blocks)).tolist()) == whole == sorted(runs(text.decode())[1])


def test_ranks_are_gapless_over_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") % 40).alias("doc_id"), F.lit(1).cast("long").alias("n_features"), (F.col("id") % 7).alias("score"))
    got = res.ranks(materialize(rows, "test-ranks"), 1000).collect()
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert len(got) == 3000 and [r["rank"] for r in drawn] == list(range(1, 1001))
    keys = [(-r.score, r.doc_id) for r in drawn]
    assert keys == sorted((-(i % 7), i % 40) for i in range(3000))[:1000]
