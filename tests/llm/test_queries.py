"""Every contract query on small tables with nulls, repeats, clashing columns and empty inputs."""

import hashlib
import random
import zlib

import pytest

from sievework.llm import bpe, packing
from sievework.llm.queries import oracle_sql, queries
from tests.llm.test_collocations import brute as brute_phrases
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_licenses import brute as brute_license
from tests.llm.test_pairbpe import brute as brute_ids
from tests.llm.test_resampling import brute as brute_draw
from tests.llm.test_simhash import brute_components
from tests.llm.test_tokens import OWN

COLUMNS = {
    "op1_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op2_license_scans": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op8_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op11_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12_pair_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "pipeline": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


def texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)] + ["MIT license", "é漢", "\n", "\n\n", "Same line\nhere", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 60, 400])))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(12)] + [(200 + i, "one footer\nof many\n" + rows[i][1]) for i in range(12)]
    return rows + [(None, None), (None, ""), (None, "no id"), (7, "shared id"), (7, "shared id"), (300, " ".join(rng.choice(words[:300]) for _ in range(60_000)))]


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 as row", "'x' as words", "2 as fingerprint", "3 as shard", "4 as _n_lines", "5 as length", "6 as k").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (4, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"http://a{i % 3}.com/fr/{i}", "") for i in range(30)] + [(None, None, None), (5, "x", "")], "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as row").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts()[20:40])] + [(None, None)], "item_id long, text string").selectExpr("*", "'b' as key").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def results(sf, spark):
    return {name: query(spark, sf).collect() for name, query in queries().items()}


def test_columns_and_rows(results):
    n = len(texts())
    for name, want in COLUMNS.items():
        rows = results[name]
        assert want <= set(rows[0].asDict()), name
        if name not in ("op9_packing", "op10_url_filters", "op11_collocations", "pipeline"):
            assert len(rows) == n and sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts()), name
    assert set(oracle_sql()) <= set(COLUMNS) and len(results["op10_url_filters"]) == 32


def test_licenses_components_lines_against_brute_force(results):
    rows = texts()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in results["op2_license_scans"]), key=str)
    assert got == sorted((brute_license(*r) for r in rows), key=str)
    known = [r for r in rows if r[0] is not None]
    got = {(r.doc_id, int(r.fingerprint, 16)) for r in results["op3_simhash"] if r.doc_id is not None}
    assert got == {(i, f) for i, f, _ in brute_components(known, 2)}
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in results["op7_line_dedup"]), key=str) == brute_lines(rows, 10, 1)


def test_ids_of_both_tokenizers(results):
    want = sorted(((i, len(OWN.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, OWN.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts()), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results["op8_byte_bpe"]), key=str) == want
    import public_tokenizers

    path = public_tokenizers.path(bpe.RANKS)
    sizes = sorted(len(packing.text_ids(t or "", path)) // 4 + 1 for _, t in texts())
    held = {}
    for r in results["op9_packing"]:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for x in held.values() for _, n in x) == sum(sizes)
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(held) <= sum(sizes) // 1024 + 2


def test_phrases_ids_and_draws_against_brute_force(results):
    rows = texts()
    assert [tuple(r) for r in sorted(results["op11_collocations"], key=lambda r: r.rank)] == brute_phrases([("en", t) for _, t in rows])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results["op12_pair_bpe"]), key=str) == sorted(((i, *brute_ids(t)) for i, t in rows), key=str)
    assert sorted(map(tuple, results["op13_resampling"]), key=str) == brute_draw(rows, [t for _, t in rows[20:40]])


def test_shards_are_even_gapless_and_keep_groups(results):
    rows = results["op5_sharding"]
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(x == list(range(len(x))) for x in by.values())
    sizes = sorted((r.size, r.text_crc32) for r in rows)
    assert sizes == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts()) and {r.law for r in rows} == {"rows"}
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, []).append(r.shard)
    tied = [x for x in where.values() if len(x) > 1]
    assert sum(len(x) - max(x.count(s) for s in set(x)) for x in tied) <= sum(map(len, tied)) // 4


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(name, spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = queries()[name](spark, path)
    assert COLUMNS[name] <= set(out.columns) and out.collect() == []
