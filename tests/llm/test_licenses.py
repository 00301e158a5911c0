import re

from sievework.llm import licenses as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(doc, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hits = [(i, label) for phrase, label in L.BASE_PHRASES for q in [phrase.split()] for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    return doc, len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


MIT = L.NOTICES[0][0]
ROWS = [
    (1, None), (2, ""), (3, "...!!"), (4, "MIT license"), (5, "The MIT-License; mit\nlicense. GNU General Public License"), (6, "mit license " * 3000), (7, "ÉMIT license mit licensé apache_license"),
    (8, MIT.upper()), (9, MIT.replace(" copy of", " whole copy of")), (10, " ".join(MIT.split()[:9])), (11, "Licensed under CC BY-NC 4.0."), (11, "general public"), (11, "general public"), (None, "mit license"),
]


def test_base_places_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "'x' as label")
    got = L.scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted((brute(*r) for r in ROWS), key=str)
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "mit" and by[8].score == 1.0 and by[9].labels == "mit" and by[9].score < 1
    assert by[10].labels == "" and 0 < by[10].score < L.COVERED and by[1].score == 0.0
    assert {r.labels for r in got if r.doc_id == 11} == {"cc-by-nc", ""}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_is_scanned_once(spark):
    words = ["w%d" % (i % 997) for i in range(200_000)]
    words[5:7] = words[199_000:199_002] = ["MIT", "license"]
    (row,) = L.scan(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (200_000, 2, 5, 199_000)
