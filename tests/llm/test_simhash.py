import random

import numpy as np
import pytest
import xxhash

from sievework.llm import simhash


def brute_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits:
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(prints):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, f, least[root(x)]) for x, (i, f) in enumerate(prints))


def variants(seed, n):
    rng, words = random.Random(seed), [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(n):
        if not base or rng.random() < 0.3:
            base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 80, 400]))]
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).title() if rng.random() < 0.2 else "\n".join(text)))
    return rows


def test_pairs_match_brute_force_over_fixture(spark):
    rows = [(7, None), (3, ""), (9, " \t\n"), (11, "One"), (12, "oNE"), (13, "é É A"), (13, "é É A")] + [(i + 20, t) for i, t in variants(1, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as root")
    for bits, cap in ((2, 8192), (2, 3), (6, 8192), (6, 4)):
        got = sorted((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, 3, bits, cap).collect())
        assert got == brute_components(rows, bits)


def test_index_finds_every_pair_of_a_dense_group():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base for i in range(40) for j in range(i)]
    values = np.unique(np.array(near, np.uint64))
    values = values[np.argsort(simhash.gray_rank(values))]
    got = {(int(x), int(y)) for a, b in simhash.links(values, 2, chunk=1 << 12) for x, y in zip(a, b)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want


def test_masks_meet_for_any_two_within_the_bits():
    rng = random.Random(3)
    for bits in (1, 2, 6):
        masks = simhash.first_masks(bits)
        for _ in range(200):
            differ = sum(1 << p for p in rng.sample(range(64), bits))
            met = [m for m in masks if not differ & m]
            assert met and all(any(not differ & x for x in simhash.finer_masks(m, bits)) for m in met)


def test_forest_of_many_groups_finds_every_pair_once():
    rng = np.random.default_rng(6)
    for bits in (1, 2, 5):
        groups, values = [], []
        for g, n in enumerate([1, 2, 3, 16, 17, 40, 300, 1, 5]):
            base = rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
            flips = [np.uint64(sum(1 << int(p) for p in rng.integers(0, 64, rng.integers(0, 4)))) for _ in range(n)]
            own = np.unique(np.array([b ^ f for b, f in zip(rng.choice(base, n), flips)], np.uint64))
            values.append(own[np.argsort(simhash.gray_rank(own))])
            groups += [g] * len(own)
        all_ = np.concatenate(values)
        starts = np.cumsum([0] + [len(v) for v in values[:-1]])
        for chunk in (8, 1 << 20):
            got = [(int(x), int(y)) for a, b in simhash.links(all_, bits, starts, chunk) for x, y in zip(a, b)]
            want = {(i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if groups[i] == groups[j] and int(all_[i] ^ all_[j]).bit_count() <= bits}
            assert len(got) == len(set(got)) and set(got) == want


def test_groups_over_several_batches_and_above_the_cap():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    sizes, rows = [1, 30, 2, 400, 3, 3, 90, 1], []
    for g, n in enumerate(sizes):
        base = int(rng.integers(0, 1 << 62))
        rows += [(7, g, v, v) for v in sorted({base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 60, (n, 2))})]
    table = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    whole = pa.RecordBatch.from_arrays(table, ["mask", "part", "fingerprint", "label"])
    for cap in (None, 50):
        seen = []
        for step in (1, 7, 64, 10_000):
            found = [b for b in simhash._group_edges((whole.slice(i, step) for i in range(0, len(rows), step)), 4, cap)]
            seen.append(sorted({tuple(r.values()) for b in found for r in b.to_pylist()}))
        assert all(x == seen[0] for x in seen) and {k for k, _, _ in seen[0]} == ({0} if cap is None else {0, 1})


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (5, "quite another text it is", "z"), (5, "quite another text it is", "z"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r.source) for r in simhash.keep_one(docs).collect()) == [(0, "n"), (1, "x"), (5, "z")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).columns == ["doc_id", "text"]


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "Ünï cödé wörds ÀÉ x", "x " * 70000])
def test_fingerprint_of_one_text(text):
    assert simhash.simhash(text.encode(), 3) == brute_fingerprint(text)


def test_a_chain_of_several_hundred_is_one_component(spark, monkeypatch):
    ids = list(range(400))
    random.Random(4).shuffle(ids)
    rounds = []
    monkeypatch.setattr(simhash, "materialize", lambda df, label, f=simhash.materialize: rounds.append(label) or f(df, label))
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001)], "a long, b long")
    got = sorted(tuple(r) for r in simhash.components(edges, "chain").collect())
    assert got == [(i, 0) for i in range(400)] + [(1000, 1000), (1001, 1000)]
    assert len(rounds) < 24
