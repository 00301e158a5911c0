"""Toxic passages by maximum-scoring segments over token log-odds.

Training (bounded: `sample` labelled rows, chosen by the hash of doc_id, equal texts once) counts in how many toxic and
clean documents each form occurs: a form is a lower-cased word or one of its prefixes of four to six letters, so that
inflections of a toxic stem share evidence. A form's log-odds has an informative Dirichlet prior: pseudo-counts
proportional to the form's background rate. Forms whose log-odds is significant (z above Z_LEAST) carry their log-odds as
score; every other word costs DRIFT. The form statistics come from four fifths of the sample.

Scoring is one linear scan of each text (all maximal segments, kept on a stack). Segment scores are normalised by the
extreme-value (Gumbel) law that best segments of the clean texts of the other fifth follow: location in proportion to the
logarithm of the length, so long texts get no bonus for chance. Segments below the significance level PASSAGE_P are
passages. A document's evidence aggregates its segments: the law of the sum of the r best normalised scores says how
unlikely that sum is for chance, each further segment has its price, and the least likely r counts. The document's score
is the calibrated probability of the label given the evidence.

Defined cases: null and empty texts have no words and score as texts without evidence; labels with a null part are left
out of training, and a text that has both labels counts as toxic; without toxic or without clean labels nothing is toxic
(score 0); repeated rows are scored each; an empty table gives an empty result; other columns are kept by reject_toxic,
and by score, whose two columns get underscores more where such a name is taken, and ignored by the contract query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sievework.llm.common import free_names, hash_sample, map_batches, named, text_of

#: Labelled rows that training reads at most.
SAMPLE = 16_000
#: A form counts if so many toxic training documents have it, and if its log-odds is so many deviations above zero.
LEAST_DOCS, Z_LEAST = 3, 3.5
#: Weight of the prior in documents.
PRIOR = 20.0
#: What a word without evidence costs.
DRIFT = 0.08
#: Chance below which a maximal segment counts as a toxic passage.
PASSAGE_P = 0.01
#: The normalised score of that chance under the Gumbel law.
SIGNIFICANT = -math.log(-math.log1p(-PASSAGE_P))
#: Segments that a document's evidence sums at most; further ones add less than their price.
SUMMED = 32
#: Words that a worker remembers, and the longest of them.
MEMO, MEMO_WORD = 300_000, 64
#: Columns that score adds.
ADDED = ["_score", "_passages"]
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Scores of forms, the Gumbel law of clean texts, and the calibration."""

    forms: dict[str, float]
    base: float
    per_log: float
    beta: float
    slope: float
    offset: float

    def word_score(self, word: str) -> float:
        forms = self.forms
        best = forms.get(word, 0.0)
        if len(word) > 4:
            for k in PREFIXES:
                if k < len(word) and (s := forms.get(word[:k] + "~", 0.0)) > best:
                    best = s
        return best


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of a sequence that scores hits and -drift everywhere else.

    Linear in the number of hits: candidates wait on a stack with the running totals at their left and right ends, and a
    new one is merged with those that it extends. Each knows the nearest candidate before it with a smaller left total, so
    what lies between is not looked at again.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, nearest smaller before
    total, at = 0.0, -1
    for place, score in hits:
        total -= drift * (place - at - 1)
        left, right, first = total, total + score, place
        total, at = right, place
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, _, first, _, before = stack[j]
            del stack[j:]
            j = before
        stack.append((left, right, first, place, j))
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def evidence(normals: list[float]) -> float:
    """How unlikely a document's normalised segment scores are for chance, as a negative logarithm.

    The sum x of the r best of independent Gumbel scores exceeds x with a chance of about exp(-x) x^(r-1) / (r! (r-1)!);
    choosing r costs a factor of two for each segment beyond the first. Only segments that are significant on their own are
    summed; one alone, or without any the best, counts as its own score.
    """
    best = top = max(normals)
    x = logs = 0.0
    for r, one in enumerate(sorted((v for v in normals if v >= SIGNIFICANT), reverse=True)[:SUMMED], 1):
        x += one
        if r > 1:
            logs += math.log(r) + math.log(r - 1)
            best = max(best, x - (r - 1) * math.log(x) + logs - (r - 1) * math.log(2)) if x > r - 1 else best
    return max(top, best)


def _hits(text: str, score_of: dict[str, float], model: Model) -> tuple[list[tuple[int, float]], int]:
    """(places and scores of words with evidence, number of words); score_of remembers words."""
    words = WORD.findall(text.lower())
    hits = []
    for i, w in enumerate(words):
        s = score_of.get(w)
        if s is None:
            s = model.word_score(w)
            if len(w) <= MEMO_WORD:
                if len(score_of) > MEMO:
                    score_of.clear()
                score_of[w] = s
        if s:
            hits.append((i, s))
    return hits, len(words)


def raw_score(text: str, memo: dict[str, float], model: Model) -> tuple[float, float, list[tuple[float, int, int]]]:
    """(best segment's score, the evidence of all segments, significant passages)."""
    hits, n = _hits(text, memo, model)
    return weighed(maximal_segments(hits, DRIFT), n, model)


def weighed(segments: list[tuple[float, int, int]], n: int, model: Model) -> tuple[float, float, list[tuple[float, int, int]]]:
    """The same of the segments of a text of n words."""
    centre = model.base + model.per_log * math.log(n + 1)
    if not segments:
        return 0.0, -centre / model.beta, []
    chance = lambda s: -math.expm1(-math.exp(min(50.0, -(s - centre) / model.beta)))
    passages = [x for x in segments if chance(x[0]) <= PASSAGE_P]
    return max(x[0] for x in segments), evidence([(x[0] - centre) / model.beta for x in segments]), passages


def probability(model: Model, normal: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.slope * normal + model.offset))))


def forms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "~" for w in words if len(w) > 4 for k in PREFIXES if k < len(w)}


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(key, text, toxic, fit): labelled texts, equal texts once, of at most `sample` labels, so their side is bounded."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = hash_sample(clean, "doc_id", sample)
    joined = docs.select("doc_id", text_of().cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    keyed = joined.withColumn("key", F.xxhash64("text"))
    once = keyed.groupBy("key").agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("key", "text", "toxic", (F.pmod(F.col("key"), F.lit(5)) < 4).alias("fit"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from at most `sample` labelled rows; None if either label is missing."""
    rows = every = _sample(docs, labels, sample).cache()
    n = every.count()
    if n > sample:  # a labelled doc_id may have many rows
        rows = every.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else clean).update(forms_of(text))
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], ["form", "in_toxic", "in_clean"])

    fit = rows.where("fit")
    sizes = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        every.unpersist()
        return None
    counted = map_batches(fit.select("text", "toxic"), count, "form string, in_toxic long, in_clean long").groupBy("form").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    rate = (F.col("t") + F.col("c")) / (n_toxic + n_clean)
    prior = F.lit(PRIOR) * rate + 0.01
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + PRIOR) - F.col(y) - prior + 0.02))
    scored = counted.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds("t", n_toxic) - odds("c", n_clean)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)))
    # Forms in LEAST_DOCS of a bounded sample's toxic texts: bounded with the sample.
    forms = {r.form: round(r.odds, 6) for r in scored.where((F.col("z") >= Z_LEAST) & (F.col("odds") > 1.0)).select("form", "odds").collect()}
    first = Model(forms, 0.0, 0.0, 1.0, 1.0, 0.0)

    memo: dict[str, float] = {}

    def top(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, sizes = [], []
        for text in batch.column(0).to_pylist():
            hits, n = _hits(text, memo, first)
            scores.append(sorted((x[0] for x in maximal_segments(hits, DRIFT)), reverse=True)[:SUMMED])
            sizes.append(n)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], ["toxic", "top", "n"])

    # At most SUMMED + 2 numbers for each row of the bounded sample.
    seen = map_batches(rows.where("not fit").select("text", F.col("toxic").cast("int")), top, "toxic int, top array<double>, n long").collect()
    every.unpersist()
    return _calibrated(forms, np.array([r.toxic for r in seen], float), [r.top for r in seen], [r.n for r in seen])


def _calibrated(forms: dict[str, float], y: np.ndarray, tops: list[list[float]], sizes: list[int]) -> Model:
    """The Gumbel law from clean rows (moments about a line in log length), then a logistic curve by Newton's method."""
    clean = y == 0
    logs, s = np.log(np.array(sizes, float) + 1), np.array([max(t, default=0.0) for t in tops])
    if clean.sum() >= 2:
        x = logs[clean]
        per_log = max(0.0, float(np.cov(x, s[clean])[0, 1] / max(x.var(ddof=1), 1e-9)))
        rest = s[clean] - per_log * x
        beta = max(0.25, float(rest.std() * math.sqrt(6) / math.pi))
        base = float(rest.mean() - 0.5772156649015329 * beta)
    else:
        per_log, beta, base = 0.0, 1.0, 0.0
    law = Model(forms, base, per_log, beta, 1.0, -3.0)
    normal = np.array([weighed([(v, 0, 0) for v in t], n, law)[1] for t, n in zip(tops, sizes)])
    if y.min(initial=1.0) == y.max(initial=0.0):
        return law
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.clip(normal, -20, 20)
    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(forms, base, per_log, beta, float(max(a, 1e-6)), float(b))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, all columns, with the score (double) and the toxic passages, array<struct<score, first, last>> (words from 0);
    names are free_names of ADDED."""
    names = docs.columns
    at, more = names.index("text"), free_names(names, ADDED)
    passage = StructType([StructField("score", DoubleType()), StructField("first", IntegerType()), StructField("last", IntegerType())])
    schema = StructType([*docs.schema.fields, StructField(more[0], DoubleType()), StructField(more[1], ArrayType(passage))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}  # each task has its own

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        scores, passages = [], []
        for text in batch.column(at).to_pylist():
            if m is None:
                scores.append(0.0)
                passages.append([])
                continue
            _, weight, found = raw_score(text or "", memo, m)
            scores.append(probability(m, max(-20.0, min(20.0, weight))))
            passages.append([{"score": s, "first": a, "last": b} for s, a, b in found])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], [*names, *more])

    return map_batches(docs, one, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that score at or above the threshold."""
    names = docs.columns
    kept = named(free_names(names, ADDED)[0]) < threshold
    return score(docs, train(docs, labels)).where(kept).select(*map(named, names))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's score; rows whose crc32(doc_id) mod 4 is 2 are never trained on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = train(docs, labels.where(~held))
    done = score(docs, model)
    return done.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("_passages").alias("n_passages"))
