import random

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from sievework.llm import bpe, linededup, quality, toxicity
from tests.llm.test_nearcopies import brute as brute_near

OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})


def corpus(n=420, seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        text = [rng.choice(words) for _ in range(rng.randint(70, 300))]
        for _ in range(rng.randint(4, 9) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["vilest", "wretches", "scumming"])
        text = [w + "%%%" for w in text] if junk else text
        body = "\n".join(" ".join(text[j : j + 25]) for j in range(0, len(text), 25))
        docs.append((i, body + ("\nShared footer line" if i % 9 == 0 else ""), "en", "s", len(body)))
        labels.append((i, int(not junk), int(toxic)))
    for k in range(40):  # exact and near copies
        _, body, *_ = docs[k]
        docs.append((1000 + k, body if k % 2 else body.replace(" ", "  ", 1) + " tail", "en", "s", 1))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "short", "en", "s", 5)]
    return docs, labels


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    tags = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before, now = now, stage(spark, now, sf)
        if name != "packing":
            assert now.columns == list(P.COLUMNS)
        seen[name] = (before, spark.createDataFrame(now.collect(), now.schema))
        now = seen[name][1]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    # Quality: the base counts and the model, document by document.
    before, after = map(texts, seen["quality"])
    model = quality.train(seen["quality"][0], tags)
    want = {i for i, t in before.items() if (b := quality.base_counts((t or "").encode()))[0] >= 50 and 100 * b[4] <= 50 * b[0] and model.probability((t or "").encode()) >= quality.THRESHOLD}
    assert set(after) == want and not any("%%%" in t for t in after.values())
    # Toxicity: likewise.
    before, after = map(texts, seen["toxicity"])
    m = toxicity.train(seen["toxicity"][0], tags)
    want = {i for i, t in before.items() if toxicity.probability(m, max(-20.0, min(20.0, toxicity.raw_score(t, {}, m)[1]))) < toxicity.THRESHOLD}
    assert set(after) == want
    truth = {i: t for i, _, t in labels}
    assert sum(truth.get(i, 0) for i in after) <= 2 and sum(1 - truth[i] for i in before if i in truth and i not in after) <= 2
    # Line dedup.
    before, after = map(texts, seen["line_dedup"])
    assert set(after) == set(before) and all("Shared footer line" not in t.split("\n") for t in after.values()) and all(r.n_chars == len(r.text) for r in seen["line_dedup"][1].collect())
    assert {i: linededup._kept(t.encode(), {k for k in linededup.line_keys(b"Shared footer line", 1)}, 1)[0].decode() for i, t in before.items()} == after
    # Near-duplicates: the smallest doc_id of each component.
    before, after = map(texts, seen["near_dedup"])
    assert set(after) == {i for i, c in brute_near(sorted(before.items())) if i == c}
    # Packing: every token once.
    before = texts(seen["packing"][0])
    pieces = seen["packing"][1].collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in before} == {i: len(OWN.encode_ordinary(t)) + 1 for i, t in before.items()}
    gaps: list[int] = []
    for n in sorted((r.length for r in pieces), reverse=True):  # best fit, longest first
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 1024) - n)
    assert len({r.sequence_id for r in pieces}) <= len(gaps) + 1


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).collect() == []
