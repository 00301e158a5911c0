"""Chained exclusion, pattern tables, table identity, sequential quotas, one-pass intervals and council grids against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.operators import exclusion, identity, patterns, quotas


def test_filter_never_forgets(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(2000)] + [(None,)], "k string")
    for bits in (1 << 16, 64):
        words = exclusion.bloom(keys, bits)
        got = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
        got = {r.id: r.m for r in got.select("id", exclusion.may_hold(words, F.col("k"), bits).alias("m")).collect()}
        assert all(got[i] for i in range(2000)) and got[-1] is False
        if bits > 64:
            assert sum(got[i] for i in range(2000, 4000)) < 60


@pytest.mark.parametrize("bits", [exclusion.BITS, 64])
def test_chained_exclusion(spark, bits):
    rng = random.Random(3)
    data = [(i, rng.choice([None, *"abcdef"]), rng.choice([None, *range(40)]), f"b{rng.randrange(300)}") for i in range(1500)]
    data += data[:20]
    rows = spark.createDataFrame(data, "id long, source string, game long, board string")
    held = {"source": ["a", None], "game": [3, 5, 5, None], "board": [f"b{i}" for i in range(0, 300, 7)]}
    kinds = {"source": "string", "game": "long", "board": "string"}
    sides = {k: spark.createDataFrame([(v,) for v in vs], f"v {kinds[k]}") for k, vs in held.items()}
    want = sorted(i for i, s, g, b in data if not ((s is not None and s in held["source"]) or (g is not None and g in held["game"]) or b in held["board"]))
    assert sorted(r.id for r in exclusion.chained_anti(rows, sides, bits).collect()) == want
    none = {"game": sides["game"].limit(0)}
    assert exclusion.chained_anti(rows, none, bits).count() == len(data) and exclusion.chained_anti(rows.limit(0), sides, bits).collect() == []


def test_rows_that_no_filter_knows_are_not_moved(spark):
    rows = spark.range(1000).select("id", F.lit("x").alias("board"))
    left = exclusion.chained_anti(rows, {"board": spark.createDataFrame([("y",)], "v string")})
    plan = left._jdf.queryExecution().executedPlan().toString()
    filters, exchanges = [m.start() for m in re.finditer(r"\bFilter\b", plan)], [m.start() for m in re.finditer(r"\bExchange hashpartitioning|BroadcastExchange", plan)]
    assert filters and (not exchanges or filters[0] < exchanges[0]) and "ubquery" in plan


def brute_family(text, table, parts, default):
    hits = sorted((p, f, x) for f, p, x, _ in set((f, p, x, None) for f, p, x, _ in table) if text is not None and re.search(x, text))
    if hits:
        return hits[0][1]
    return next((f for part, f in parts if text is not None and part in text.lower()), default)


def test_pattern_table(spark):
    table = [("open", 3, r"(?i)\bcent(er|re)\b", ["cent"]), ("king", 1, r"(?i)\b(castle|king safety)\b", ["castle", "king"]), ("short", 2, r"\bgo\b", ["go"]), ("any", 9, r"\d{3}", []), ("open", 3, r"(?i)\bcent(er|re)\b", ["cent"]), ("late", 1, r"(?i)\bcastle\b", ["castle"]), ("ünder", 4, r"\b[Üü]nder", ["ünder"]), ("null", 8, r"zzz$", None)]
    parts = [("tempo", "initiative"), ("o", "vowel")]
    texts = ["The Centre and go", "castle now", "king safety", "king", "we go 123", "tempo 12", "no", "555", "", None, "Ünder it", "zzz", "GO", "centering", "castle; king safety go centre 999"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = spark.createDataFrame(table, "family string, priority int, pattern string, starts array<string>")
    got = {r.id: r.family for r in patterns.first_family(rows, "id", "text", known, parts, "none").collect()}
    assert got == {i: brute_family(t, table, parts, "none") for i, t in enumerate(texts)}
    out = patterns.first_family(rows, "id", "text", known)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert patterns.first_family(rows, "id", "text", known.limit(0)).where("family is not null").count() == 0


def brute_differences(left, right):
    a, b = {}, {}
    for rows, side in ((left, a), (right, b)):
        for k, *rest in rows:
            side.setdefault(k, Counter())[tuple(rest)] += 1
    out = []
    for k in {*a, *b}:
        x, y = a.get(k, Counter()), b.get(k, Counter())
        if x != y:
            out.append((k, "missing" if not y else "extra" if not x else "repeated" if set(x) == set(y) else "changed", sum(x.values()), sum(y.values())))
    return sorted(out, key=str)


def test_identity(spark):
    rng = random.Random(4)
    left = [(rng.choice([None, *range(60)]), rng.choice([None, "a", "b"]), rng.choice([None, 1.5])) for _ in range(300)]
    right = left[:]
    rng.shuffle(right)
    kind = "k long, v string, w double"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    identity.assert_same(frame(left), frame(right), ["k"], ["v", "w"])
    assert identity.differing_keys(frame(left), frame(right), ["k"], ["v", "w"]).collect() == []
    right = [r for r in right if r[0] != 7][:-3] + right[:5] + [(99, None, None), (99, None, None), (3, "new", None)]
    for ranges in (identity.RANGES, 2):
        got = identity.differing_keys(frame(left), frame(right), ["k"], ["v", "w"], ranges).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_differences(left, right)
    with pytest.raises(ValueError):
        identity.assert_same(frame(left), frame(right), ["k"], ["v"])
    assert identity.differing_keys(frame([]), frame([]), ["k"], ["v"]).collect() == []
    assert [(r.k, r.kind) for r in identity.differing_keys(frame([]), frame([(None, "x", 1.0)]), ["k"], ["v"]).collect()] == [(None, "extra")]


def one_by_one(rows, left):
    left, out = dict(left), []
    for order, tags in sorted(r for r in rows if r[0] is not None):
        tag = next((t for t in tags or [] if left.get(t, 0) > 0), None)
        if tag is not None:
            left[tag] -= 1
            out.append((order, tag))
    return sorted(out)


def test_quotas_as_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(quotas, "CELLS", 4)
    for limits in ({"a": 20, "b": 30, "c": 1, "d": 0}, {"a": 5, "b": 5, "c": 5}, {"a": 10**6}):
        rows = [(i * rng.choice([1, 1]) + (10**12 if i > 400 else -50), rng.choice([None, []] + [[rng.choice("abcdxy") for _ in range(rng.randint(1, 4))] for _ in range(6)])) for i in range(500)] + [(None, ["a"])]
        got = quotas.greedy_quota(spark.createDataFrame(rows, "o long, tags array<string>"), "tags", "o", limits)
        assert sorted(map(tuple, got.collect())) == one_by_one(rows, limits)
        assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def poisson(seed, b, item):
    import hashlib
    import math

    u = int.from_bytes(hashlib.sha256(f"{seed}|{b // 8}|{item}".encode()).digest()[4 * (b % 8) : 4 * (b % 8) + 4])
    return next(k for k in range(99) if u < math.floor(4294967296 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))))


def test_one_pass_intervals(spark):
    from sievework.operators import metrics

    rng = random.Random(6)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, rng.random() * 10])) for _ in range(300)]
    means = []
    for b in range(50):
        w = [(poisson(3, b, "" if i is None else i), v) for i, v in rows if v is not None]
        means.append(sum(k * v for k, v in w) / sum(k for k, _ in w))
    means.sort()
    table = spark.createDataFrame(rows, "item long, v double")
    for rule, at in (("last", lambda q: int(q * 49)), ("count", lambda q: min(49, int(q * 50)))):
        for parts in (1, 5):
            got = metrics.poisson_bootstrap(table.repartition(parts), "item", "v", 50, 3, rule).first()
            assert (got.low, got.high) == pytest.approx((means[at(0.025)], means[at(0.975)]))
    assert tuple(metrics.poisson_bootstrap(table.limit(0), "item", "v", 50, 3).first()) == (None, None)
    wide = metrics.poisson_bootstrap(spark.range(2000).select("id", F.rand(1).alias("v")), "id", "v", 400, 5).first()
    assert 0.02 < wide.high - wide.low < 0.03  # 4 standard errors of 2000 uniform numbers are 0.0258


def test_council_of_odd_rows(spark):
    from sievework.operators import council

    kind = "condition string, judge string, ranking array<string>, names map<string,string>, scores map<string,map<string,int>>"
    rows = [
        ("g", "x", ["B", "A"], {"A": "m", "B": "n", "C": "o"}, {"A": {"clarity": 4}, "C": {"clarity": None, "other": 9}}),
        ("g", "y", ["A", "B", "C"], {"A": "m", "B": "n", "C": "o"}, None),
        ("h", "x", None, {"A": "m"}, {}), ("h", "y", [], {}, {}), ("h", None, ["A"], None, {}),
    ]
    got = {(r.grid, r.condition, r.judge, r.member): (r.n, r.mean_rank, r.win_rate, r.n_clarity, r.mean_clarity, r["items"]) for r in council.council(spark.createDataFrame(rows, kind), ["clarity"]).collect()}
    assert got["members", "g", None, "m"] == (2, 1.5, 0.5, 1, 4.0, None) and got["members", "g", None, "o"] == (1, 3.0, 0.0, 0, None, None)
    assert got["judges", "g", "x", "n"] == (1, 1.0, 1.0, 0, None, None) and got["members", "h", None, "m"] == (0, None, None, 0, None, None)
    assert got["pooled", None, "x", "m"] == (1, 2.0, 0.0, 1, 4.0, None)
    assert got["items", "g", None, None] == (None,) * 5 + (2,) and got["items", "h", None, None] == (None,) * 5 + (3,)
    assert council.council(spark.createDataFrame([], kind), ["clarity"]).collect() == []


def test_telemetry_of_mixed_rows(spark):
    from sievework.operators import council

    kind = "model string, ungated boolean, attempts int, fallback boolean, clean boolean, formed boolean, sound boolean, fabricated boolean"
    rows = [("a", True, 1, None, True, True, None, False), ("a", None, 9, True, False, False, True, True), ("b", False, None, True, True, None, True, True), ("b", False, 4, False, False, True, True, True), (None, None, None, None, None, None, None, None)]
    got = {r.model: tuple(r)[1:] for r in council.telemetry(spark.createDataFrame(rows, kind), "model").collect()}
    assert got["a"] == (False, 1, None, None, 1.0, 1.0, 0.0, 1.0) and got["b"] == (True, 2, 2.5, 0.5, 0.5, 0.5, None, None) and got[None] == (True, 1, 1.0, 0.0, 0.0, 0.0, None, None)
    rows = [("a", True, True, True, 3), ("a", True, False, False, 2), ("a", None, None, None, None)]
    (r,) = council.resolution(spark.createDataFrame(rows, "model string, raw_fabricated boolean, gated_fabricated boolean, fallback boolean, attempts int"), "model").collect()
    assert (r.n, r.raw_rate, r.gated_rate, r.delta, r.mean_attempts, r.fabricated, r.by_model, r.by_fallback, r.still) == (3, 0.6667, 0.3333, -0.3334, 2.5, 2, 1, 1, 1)


def test_pending_combinations(spark):
    from sievework.operators import joins

    users = spark.createDataFrame([(1,), (2,), (None,), (2,)], "u long")
    kinds = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    modes = spark.createDataFrame([(0,), (1,)], "m int")
    done = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, None, 1), (2, "z", 0), (9, "a", 1)], "u long, k string, m int")
    want = sorted(((u, k, m) for u in (1, 2, None) for k in ("a", "b", None) for m in (0, 1) if (u, k, m) not in {(1, "a", 0), (None, None, 1)}), key=str)
    assert sorted((tuple(r) for r in joins.pending([users, kinds, modes], done, ["u", "k", "m"]).collect()), key=str) == want
    two = joins.pending([users, kinds], done, ["u", "k"])
    assert sorted((tuple(r) for r in two.collect()), key=str) == sorted(((u, k) for u in (1, 2, None) for k in ("a", "b", None) if (u, k) not in {(1, "a"), (None, None)}), key=str)
    assert "Cross" not in two._jdf.queryExecution().optimizedPlan().toString()
    assert [r.u for r in joins.pending([users], done.where("u is null or u <> 2"), ["u"]).collect()] == [2]


def test_tasks_of_orders_are_bounded_whatever_the_shuffle_partitions(spark, monkeypatch):
    from sievework.plans import fixtures

    monkeypatch.setattr(fixtures, "LINES", 100, raising=False)
    rows = fixtures.fact(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert rows.rdd.getNumPartitions() == -(-lines // 100) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_patterns_by_pairs_of_words_try_few_and_find_the_same(spark):
    texts = [(1, "the cat sat"), (2, "so the\n\t DOG ran"), (3, "the old dog"), (4, None), (5, "breathe dog"), (6, "the dogs"), (7, "the, dog"), (8, "THE cat"), (9, "the")]
    rows = spark.createDataFrame(texts, "id long, text string")
    rule = r"(?i)(^|[^\p{L}\p{N}])%s[ \n\t]+%s($|[^\p{L}\p{N}])"
    known = spark.createDataFrame([("a", 2, rule % ("the", "dog"), ["the dog"], ["the"]), ("b", 1, rule % ("the", "cat"), ["the cat"], ["the"])], "family string, priority long, pattern string, two array<string>, one array<string>")
    by_pairs, by_words = (known.select("family", "priority", "pattern", F.col(c).alias("starts")) for c in ("two", "one"))
    got = [{r.id: r.family for r in patterns.first_family(rows, "id", "text", k, pairs=p).collect()} for k, p in ((by_pairs, True), (by_words, False))]
    assert got[0] == got[1] == {1: "b", 2: "a", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "b", 9: None}
    tried = patterns.candidates(rows, "id", "text", by_pairs.withColumn("pattern_id", F.col("priority")), True)
    assert {(r.id, r.pattern_id) for r in tried.collect()} == {(1, 1), (2, 2), (7, 2), (8, 1)}


def test_a_histogram_of_reasons_asks_its_tests_once(spark):
    from sievework.operators import gates

    rows = spark.createDataFrame([(1, " a  b "), (2, "abc"), (3, None)], "id long, text string").repartition(2).withColumn("body", F.regexp_replace("text", " +", ""))
    out = gates.reason_histogram(gates.with_reasons(rows, [("short", F.length("body") < 3), ("b", F.contains("body", F.lit("b")))]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1, plan
    assert {(r.reason, r.n) for r in out.collect()} == {("short", 1), ("b", 2)}
