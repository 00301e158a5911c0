"""Importance resampling: documents are drawn by how much likelier their word runs are in a target than in the corpus.

A feature is a run of one or two words, known by the CRC-32 of its bytes modulo the number of buckets. The first pass
counts each partition's features in one vector (np.bincount), and treeReduce adds the vectors up; the gains of the buckets
follow from the two vectors of target and corpus, are as many as there are buckets whatever the corpus, and are broadcast.
The second pass gathers the gains of a document's features and sums them with np.bincount weights.

Drawing is by the Gumbel top-k rule: a document's score is its weight plus noise from a hash of its doc_id, and the
highest scores are drawn. Ranks are taken without a global window: rows are dealt into ranges of (score, doc_id) whose
edges come from a hash sample, counted, and ranked inside their range from where the ranges before it end; ranges that lie
beyond the last rank are not ranked at all.

Defined cases: a null or empty text, or one without words, has no features and weight 0; without documents or without a
target the counts are 0 and the gains follow from that; the noise of a null doc_id is that of the empty string, and null
ties last; rows that share a doc_id are drawn each, equal ones in any order (their columns agree but for the rank); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import MOST_SAMPLED, find_edge, hash_sample, map_batches, materialize, parts, raw_texts, slices

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Ranges for each shuffle partition, and rows sampled for each range; they only steer the dealing.
RANGES_PER_PARTITION, SAMPLED_PER_RANGE = 2, 32
#: What is no letter a-z, digit or byte above 127 becomes a space; A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A text is hashed in blocks of so many words.
BLOCK = 1 << 18


def features(text: bytes, buckets: int = BUCKETS) -> tuple[int, Iterator[np.ndarray]]:
    """How many words a text has, and in blocks the buckets of its words and of its pairs of neighbouring words."""
    words = text.translate(_WORDS).split()

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, len(words), BLOCK):
            own = words[at : at + BLOCK + 1]  # and the next block's first word
            single = list(map(crc32, own))
            # CRC-32 goes on from where a word ended, so a pair costs its second word alone.
            pairs = list(map(crc32, [b" " + w for w in own[1:]], single))
            yield np.array(single[:BLOCK] + pairs, np.int64) % buckets

    return len(words), blocks()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, column: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket: one vector from each partition, added up as a tree."""

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in raw_texts(part.column(0)):
                    for own in features(text, buckets)[1]:
                        seen += np.bincount(own, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["seen"])

    rows = docs.select(F.col(column).cast("string")).mapInArrow(vector, "seen binary").rdd
    if not rows.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return rows.map(lambda r: np.frombuffer(r.seen, np.int64)).treeReduce(np.add)


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln of each bucket's share of the target over its share of the corpus), both smoothed by one."""
    n, t_all, s_all = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + n)) / (float(s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; the weight is the floored mean gain of its features."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = sent.value.astype(np.float64)  # sums of whole numbers below 2**53 are exact
        rows = batch.num_rows
        n_words, n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        held: list[np.ndarray] = []
        of: list[int] = []

        def add() -> None:
            doc = np.repeat(of, [len(x) for x in held])
            n[:] += np.bincount(doc, minlength=rows)
            total[:] += np.bincount(doc, weights=table[np.concatenate(held)], minlength=rows)
            held.clear()
            of.clear()

        for i, text in enumerate(raw_texts(batch.column(1))):
            n_words[i], blocks = features(text, buckets)
            for own in blocks:
                held.append(own)
                of.append(i)
                if sum(map(len, held[-64:])) > BLOCK or len(held) > 4096:
                    add()
        if held:
            add()
        weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, n_words long, n_features long, weight long")


def noisy(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (with doc_id, weight) and score: the weight plus Gumbel noise from a hash of the seed and the doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def ranks(rows: DataFrame, many: int) -> DataFrame:
    """rows (a written table with row, doc_id, n_features, score) and rank: 1 to `many` by score descending, then doc_id."""
    spark = rows.sparkSession
    kind = {"down": -F.col("score"), "none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "n": F.col("n_features"), "row": F.col("row")}
    rows = rows.withColumn("k", F.struct(*[c.alias(x) for x, c in kind.items()]))
    ranges = RANGES_PER_PARTITION * parts(spark)
    keys = sorted(tuple(r.k) for r in hash_sample(rows.select("row", "k"), "row", min(MOST_SAMPLED, ranges * SAMPLED_PER_RANGE)).select("k").collect())
    edges = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    made = lambda e: F.struct(*[F.lit(v).cast("boolean" if x == "none" else "long").alias(x) for x, v in zip(kind, e)])
    placed = rows.withColumn("range", find_edge(edges, F.col("k"), made))
    held = {r.range: r.n for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a number for each range
    before = np.concatenate([[0], np.cumsum([held.get(i, 0) for i in range(len(edges) + 1)])]).tolist()
    placed = placed.withColumn("base", F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("range")))
    drawn = placed.where(F.col("base") < many).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy("k")))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return drawn.unionByName(placed.where(F.col("base") >= many).withColumn("rank", F.lit(None).cast("long"))).drop("k", "range", "base")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null where the row is not drawn.

    floor(percent / 100 of the documents with at least min_words words) are drawn; both tables have a column `text`.
    """
    gain = gains(bucket_counts(target, buckets), bucket_counts(docs, buckets))
    rows = materialize(noisy(weighed(docs, gain), seed).withColumn("row", F.monotonically_increasing_id()), "weighed")
    fit = rows.where(F.col("n_words") >= min_words)
    done = ranks(fit, percent * fit.count() // 100)
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return done.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a quarter of the documents of 20 words or more, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'corpus' AS side, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark)),
runs AS (
  SELECT side, id, unnest(w) AS run FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
hexed AS (SELECT run, hex(encode(run)) AS x FROM (SELECT DISTINCT run FROM runs)),
known AS (
  SELECT run, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000)::BIGINT AS bucket FROM hexed, steps),
dealt AS (SELECT side, id, bucket, count(*) AS n FROM runs JOIN known USING (run) GROUP BY side, id, bucket),
tallies AS (SELECT b.bucket, coalesce(sum(n) FILTER (WHERE side = 'corpus'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 'target'), 0)::BIGINT AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN dealt USING (bucket) GROUP BY b.bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g
  FROM tallies, (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM tallies)),
sums AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dealt JOIN gain USING (bucket) WHERE side = 'corpus' GROUP BY id),
scores AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN sums USING (id) WHERE side = 'corpus'),
ordered AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 25 // 100 THEN place END::BIGINT AS rank FROM ordered
"""
