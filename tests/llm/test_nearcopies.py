import random

import corpus_pipeline as P
from sievework.llm import nearcopies as N


def own_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [own_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, least[root(x)]) for x, (i, _) in enumerate(rows))


def edited(seed, n):
    """Texts and chains of edits whose likeness lies on both sides of 0.8, with a passage that many share."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(40)]
    rows, base = [], []
    for i in range(n):
        if not base or rng.random() < 0.25:
            base = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 30, 90, 400]))]
            base = base + shared if rng.random() < 0.3 else base
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        base = text if rng.random() < 0.3 else base
        rows.append((i, " ".join(text).title() if rng.random() < 0.2 else "\n".join(text)))
    return rows


def test_components_as_brute_force(spark):
    rows = [(1000, None), (1001, " \n"), (1002, "One"), (1003, "oNE"), *edited(1, 300)]
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_stage_links_at_the_likeness(spark):
    rows = edited(2, 300)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.distinct_documents(spark, docs, "").collect()) == [i for i, c in brute(rows) if i == c]


def test_rows_are_known_by_all_their_columns(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [
        (None, words("a", 40), "x", 1), (None, words("b", 40), "x", 1), (7, words("c", 40), "x", 1), (7, words("d", 40), "x", 1),  # no copies: all stay
        (None, words("e", 40), "x", 1), (9, words("e", 40) + " tail", "x", 1),  # the one that has a doc_id stays
        (11, words("f", 40), "x", 1), (11, words("f", 40), "x", 1), (None, "", "x", 1), (None, None, "x", 1), (None, words("g", 40), "y", 1), (None, words("g", 40), "z", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, own_id long")
    got = N.keep_one(docs)
    assert got.columns == docs.columns
    stay = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in got.collect())
    assert stay == [(0, ""), (0, "a"), (0, "b"), (0, "g"), (7, "c"), (7, "d"), (9, "e"), (11, "f")]
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in N.keep_one(docs.repartition(7)).collect()) == stay
    assert N.keep_one(docs.limit(0)).collect() == []


def test_dense_group_comes_together_by_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    asked = []
    own = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, texts: asked.append(pairs.count()) or own(pairs, texts))
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows) and sum(asked) < 150 * 149 / 4


def test_pairs_looked_at_grow_with_the_family_not_with_its_square(spark, monkeypatch):
    """Versions of one text of which few pairs link: all come together, and texts are compared for a few pairs a version."""
    asked = []
    own = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, texts: asked.append(pairs.count()) or own(pairs, texts))
    looked = {}
    for n in (150, 600):
        rng = random.Random(n)
        rows = []
        for i in range(n):
            text = [f"w{j}" for j in range(300)]
            for at in rng.sample(range(300), 4):
                text[at] = f"x{rng.getrandbits(40)}"
            rows.append((i, " ".join(text)))
        asked.clear()
        got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got)) == brute(rows)
        looked[n] = sum(asked)
    assert looked[600] < looked[150] * 4**1.3


def test_very_long_text(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    edit = list(long)
    for _ in range(2000):
        edit[rng.randrange(len(edit))] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(edit)), (3, "w" * 3_000_000)]
    assert sorted(map(tuple, N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_plans_hold_tables_and_not_again_what_made_them(spark, monkeypatch):
    """The driver keeps a query's plan and metrics, of each time that it was planned anew, long after the query has ended."""
    reads = {}
    own = N.materialize

    def noted(df, label):
        reads[label] = max(reads.get(label, 0), df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return own(df, label)

    monkeypatch.setattr(N, "materialize", noted)
    rows = edited(3, 60)
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {"near-links", "near-tried-0", "near-rest"} <= set(reads) and max(reads.values()) <= 6, reads
