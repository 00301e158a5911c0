import random
import re
from collections import Counter

import pyarrow as pa

from sievework.llm import collocations as col

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=3, min_count=10, share=50, most=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text), in plain Python numbers."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                count.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        found = {}
        for phrase, a in f.items():
            if len(phrase) > 1 and a >= min_count:
                found[phrase] = min((1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
        inside = {}
        for phrase in found:
            for i in range(len(phrase)):
                for j in range(i + 2, len(phrase) + 1):
                    if j - i < len(phrase):
                        inside[phrase[i:j]] = max(inside.get(phrase[i:j], 0), f[phrase])
        stay = [p for p in found if 100 * inside.get(p, -1) < share * f[p]]
        stay.sort(key=lambda p: (-found[p][0], -f[p], " ".join(p).encode()))
        out += [(lang, i + 1, " ".join(p), f[p], found[p][2], found[p][3], total[lang], found[p][0]) for i, p in enumerate(stay[:most])]
    return out


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["New", "York", "É", "x.y", "a,b", "tab\tbed", "\x1c", "漢字"]
    out = [(rng.choice(["en", "en", "en", None, "", "a\tb"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 40])))) for _ in range(200)]
    return out + [("en", "new york city hall! " * 30)] + [("en", None), (None, "")] + [("en", "same text of many rows")] * 40


def test_against_plain_python(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "k") for r in data], "lang string, text string, n long, gram string").repartition(5)
    for args in ({}, {"max_n": 4, "min_count": 3, "share": 80, "most": 25}, {"max_n": 2, "min_count": 2, "most": 5}):
        assert sorted(map(tuple, col.mine(docs, **args).collect())) == sorted(brute(data, **args)), args


def test_blocks_change_nothing(spark):
    """Runs over the border of two blocks are counted once."""
    text = " ".join(random.Random(4).choice("abcdef") + random.Random(i).choice(".  ") for i in range(5000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    want = {(r.key, r.n) for r in col.exploded(docs).groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    for block in (1, 7, 100):
        assert {(r.key, r.n) for r in col.exploded(docs, block=block).groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()} == want


def test_filter_knows_what_it_was_made_of(spark):
    keys = [f"word {i}\ten" for i in range(3000)]
    for most in (1 << 27, 1 << 10):  # the second is far too small, and still forgets nothing
        filter_ = col.known(spark.createDataFrame([(k,) for k in keys], "key string"), most)
        assert filter_.holds(pa.array(keys)).all()
        if most > 1 << 20:
            assert filter_.holds(pa.array([f"other {i}\ten" for i in range(3000)])).mean() < 0.02
    assert not col.known(spark.createDataFrame([], "key string")).holds(pa.array(["x"])).any()


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 3_000_000_019, 4_000_000_007
    counts = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, gram string, order int, n long")
    assert [x.score for x in col.scored(counts).collect()] == [1000000 * a * a // (l * r)]


def test_one_language_of_many_ties_is_ranked_in_shares(spark):
    many = spark.range(5000).selectExpr("'en' lang", "concat('p', id) gram", "2 order", "10L a", "10L l", "10L r", "5L score")
    got = col.ranked(many, 100).collect()
    assert [r.gram for r in sorted(got, key=lambda r: r.rank)] == sorted(f"p{i}" for i in range(5000))[:100]
