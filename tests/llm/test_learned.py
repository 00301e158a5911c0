import math
import random

from sievework.llm import quality as Q
from sievework.llm import toxicity as X


def brute_segments(scores):
    """All maximal-scoring segments by their definition: recursive best subsegments."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-12 and (top is None or total > top[0] + 1e-9 or (abs(total - top[0]) <= 1e-9 and b - a < top[2] - top[1])):
                    top = (total, a, b)
        if top is None:
            return []
        return best(lo, top[1]) + [top] + best(top[2] + 1, hi)

    return best(0, len(scores))


def test_maximal_segments_match_their_definition():
    rng = random.Random(4)
    for _ in range(300):
        n, drift = rng.randint(1, 25), 0.7
        hits = [(i, round(rng.uniform(0.1, 3), 3)) for i in range(n) if rng.random() < 0.4]
        scores = [dict(hits).get(i, -drift) for i in range(n)]
        got = [(round(s, 6), a, b) for s, a, b in X.maximal_segments(hits, drift)]
        assert got == [(round(s, 6), a, b) for s, a, b in brute_segments(scores)]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(3, 8) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["vilest", "wretches", "scumming", "scummed"])
        text = [w + "%%%" for w in text] if junk else text
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = corpus(900, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    seen = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    model = X.train(d, seen)
    scored = {r.doc_id: r for r in X.score(d, model).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    right = sum((scored[i]._score >= X.THRESHOLD) == bool(t) for i, _, t in held)
    assert right / len(held) > 0.97 and any(scored[i]._passages for i, _, t in held if t)
    kept = X.reject_toxic(d, seen)
    assert kept.columns == d.columns and kept.count() < 900


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "words and words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.train(d, none) is None and {r._score for r in X.score(d, None).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    scores = [r._score for r in X.score(d, X.train(d, one)).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 and not math.isnan(s) for s in scores)
    assert X.score(d.limit(0), None).collect() == []


def brute_counts(text):
    import re
    from collections import Counter

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_match_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "c\n", " ", "é", "#", "|x ", "a b c ", "\x0b", "\x1c", "\u00a0", "\n\n", "😀"]) for _ in range(rng.randint(0, 60)))
        assert Q.base_counts(text.encode()) == brute_counts(text)


def test_quality_rules(spark):
    docs, labels = corpus(600, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    seen = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in Q.judge(d, Q.train(d, seen)).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert sum(judged[i]._kept == bool(q) for i, q, _ in held) / len(held) > 0.97
    assert Q.keep_good(d, seen).columns == d.columns


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 60), (3, "w " * 60), (None, " ".join(map(str, range(70))))], "doc_id long, text string")
    model = Q.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None
    got = {(r.doc_id, r._n_words, r._base_failed, r._kept) for r in Q.judge(d, model).collect()}
    assert got == {(1, 0, True, False), (2, 0, True, False), (3, 60, True, False), (None, 70, False, True)}
    assert Q.judge(d.limit(0), model).collect() == []


def test_columns_with_the_same_names_are_kept(spark):
    docs, labels = corpus(200, 3)
    d = spark.createDataFrame([(*x, 5, "k", 1.5, "p") for x in docs], "doc_id long, text string, lang string, source string, n_chars long, _n_words int, _kept string, _score double, _Passages string")
    seen = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = Q.judge(d, Q.train(d, seen))
    assert judged.columns[: len(d.columns)] == d.columns and "__n_words" in judged.columns and "__kept" in judged.columns
    kept, civil = Q.keep_good(d, seen), X.reject_toxic(d, seen)
    assert kept.columns == civil.columns == d.columns and {r._kept for r in kept.collect()} == {"k"} and {r._score for r in civil.collect()} == {1.5}
    assert X.score(d, None).columns[-2:] == ["__score", "__passages"]


def test_conflicting_labels_of_equal_texts(spark):
    docs, labels = corpus(300, 4)
    twice = docs + [(1000 + i, t, "en", "s", 1) for i, t, *_ in docs[:60]]
    opposite = labels + [(1000 + i, 1 - q, 1 - t) for i, q, t in labels[:60]]
    models = []
    for n in (2, 7):
        d = spark.createDataFrame(twice, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        seen = spark.createDataFrame(opposite, "doc_id long, quality int, toxic int").repartition(n)
        models.append((X.train(d, seen), Q.train(d, seen)))
    assert models[0][0] == models[1][0]
    assert (models[0][1].weights == models[1][1].weights).all()


def test_features_do_not_depend_on_blocks():
    import numpy as np

    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b ", "\n", "é", "abc def ", "\x0b", "xyzw"]) for _ in range(rng.randint(0, 90))).encode()
        seen = []
        for block in (1, 2, 7, Q.BLOCK):
            kinds = [[] for _ in range(4)]
            for kind, slots in Q.features(text, block):
                kinds[kind] += slots.tolist()
            seen.append([sorted(x) for x in kinds])
        assert all(x == seen[-1] for x in seen)
    long = ("word" * 2_000_000 + " and more " * 300_000).encode()
    assert Q.Model(np.ones(Q.SLOTS), 0.0, 1.0, 0.0).probability(long) > 0.5 and Q.base_counts(long)[0] == 600_001


def test_segment_scan_is_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert len(X.maximal_segments([(i * 50, 1.0) for i in range(n)], 0.08)) == n  # no two ever join
        return time.process_time() - began

    assert seconds(200_000) < 3.0


def test_evidence_of_several_passages():
    assert X.evidence([5.0]) == 5.0 and X.evidence([-2.0, -3.0]) == -2.0
    assert X.evidence([6.0, 5.5, 5.0]) > X.evidence([6.0, 5.5]) > 6.0 and X.evidence([6.0, 4.5, 0.1]) == 6.0


def test_held_out_scores_order_documents(spark, tmp_path):
    docs, labels = corpus(900, 6)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = X.op6_toxicity(spark, str(tmp_path)).collect()
    import zlib

    truth = {i: t for i, _, t in labels}
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)
    toxic = [r.score for r in got if r.held_out and truth[r.doc_id]]
    clean = [r.score for r in got if r.held_out and not truth[r.doc_id]]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert area > 0.97
    kept = Q.op4_quality_rules(spark, str(tmp_path)).collect()
    good = {i: q for i, q, _ in labels}
    assert sum(r.kept == bool(good[r.doc_id]) for r in kept) / 900 > 0.97 and all(r.n_words == len(t.split()) for r in kept for t in [dict((d[0], d[1]) for d in docs)[r.doc_id]])


def test_sample_is_bounded_where_rows_share_a_doc_id(spark):
    docs, labels = corpus(400, 7)
    shared = [(i % 40, t, "en", "s", 1) for i, t, *_ in docs]
    d = spark.createDataFrame(shared, "doc_id long, text string, lang string, source string, n_chars long")
    seen = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert Q.train(d, seen, 50) is not None and X.train(d, seen, 50) is not None
