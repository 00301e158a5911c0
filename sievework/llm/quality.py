"""Quality rules: fixed counts, and a calibrated logistic regression on hashed word and character n-grams.

Words are runs of characters other than space and the ASCII controls from tab to carriage return. The base rules fail a
text with fewer than `min_words` words, or in which over half of the words stand in a three-word window that the text
has more than once. What passes is scored by the classifier, in Arrow batches, against a fixed threshold.

Features are the relative frequencies of hashed word unigrams and bigrams and of hashed character trigrams and
five-grams (of UTF-8 bytes), each of a text's whole length. Training reads at most `sample` labelled rows (chosen by the
hash of doc_id, equal texts once), fits on three quarters of them, and calibrates the probability on the rest by a
logistic curve.

Defined cases: a null or empty text has no words, counts 0 everywhere, and fails; labels with a null part are left out of
training, and a text that has both labels counts as bad; if a label is missing from the sample the classifier passes
everything; repeated rows are judged each; very long texts are hashed block by block; an empty table gives an empty
result; other columns are kept by keep_good, and by judge, whose columns get underscores more where such a name is taken,
and ignored by the contract query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from sievework.llm.common import free_names, hash_sample, map_batches, named, text_of

#: Labelled rows that training reads at most.
SAMPLE = 4_000
WORD_SLOTS, CHAR_SLOTS = 1024, 2048
SLOTS = 2 * WORD_SLOTS + 2 * CHAR_SLOTS
THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 18
#: Columns that judge adds.
ADDED = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_quality", "_kept"]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers for the bytes of a word by their place in it.
_PLACE = np.random.default_rng(20240607).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
    size = len(seen)
    if size < 1 << 21:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, back, count = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    twice = (count > 1)[back.ravel()]
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    chars = int((((data & 0xC0) != 0x80) & ~_IS_BLANK[data]).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, int(_IS_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated_words(words)


def _words_of_blocks(data: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """The hash of every word, block by block: a sum over its bytes, so a word may go on in the next block."""
    begun, size = np.uint64(0), 0  # what the open word has so far, and of how many bytes
    for at in range(0, len(data), block):
        part = data[at : at + block]
        inside = ~_IS_BLANK[part]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        ended = size and not inside[0]
        first = np.array([begun] if ended else [], np.uint64)
        if not len(starts):
            if ended:
                yield first * _MIX
                begun, size = np.uint64(0), 0
            continue
        place = np.arange(len(part))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(part))))
        goes_on = size and inside[0]
        if goes_on:
            place[: starts[1] if len(starts) > 1 else len(part)] += size
        sums = np.add.reduceat(np.where(inside, (part.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 63], np.uint64(0)), starts)
        if goes_on:
            sums[:1] += begun
        if inside[-1]:
            begun, size = sums[-1], len(part) - int(starts[-1]) + (size if goes_on and len(starts) == 1 else 0)
            sums = sums[:-1]
        else:
            begun, size = np.uint64(0), 0
        yield np.concatenate([first, sums]) * _MIX
    if size:
        yield np.array([begun]) * _MIX


def features(text: bytes, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, slots) of the text's n-grams, of the four kinds in turn, block by block."""
    data = np.frombuffer(text, np.uint8)
    before = np.empty(0, np.uint64)
    for words in _words_of_blocks(data, block):
        if not len(words):
            continue
        yield 0, ((words >> _SHIFT) % np.uint64(WORD_SLOTS)).astype(np.int64)
        run = np.concatenate([before, words])
        pairs = (run[:-1] ^ (run[1:] * np.uint64(3) + np.uint64(1))) * _MIX
        yield 1, ((pairs >> _SHIFT) % np.uint64(WORD_SLOTS)).astype(np.int64) + WORD_SLOTS
        before = words[-1:]
    for at in range(0, len(data), block):
        wide = data[at : at + block + 4].astype(np.uint64)
        for kind, n in ((2, 3), (3, 5)):
            many = min(len(wide) - n + 1, block)
            if many > 0:
                grams = wide[:many]
                for j in range(1, n):
                    grams = grams << np.uint64(8) | wide[j : j + many]
                yield kind, ((grams * _MIX >> _SHIFT) % np.uint64(CHAR_SLOTS)).astype(np.int64) + 2 * WORD_SLOTS + (kind - 2) * CHAR_SLOTS


@dataclass(frozen=True)
class Model:
    """Weights of the relative frequencies, and the calibration of their sum."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, text: bytes) -> float:
        sums, many = [0.0] * 4, [0] * 4
        for kind, slots in features(text):
            sums[kind] += float(self.weights[slots].sum())
            many[kind] += len(slots)
        total = self.bias + sum(x / n for x, n in zip(sums, many) if n)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * total + self.offset, -60, 60)))


def _dense(text: bytes) -> np.ndarray:
    counts, many = np.zeros(SLOTS, np.int64), [0] * 4
    for kind, slots in features(text):
        counts += np.bincount(slots, minlength=SLOTS)
        many[kind] += len(slots)
    sizes = np.repeat(np.maximum(many, 1), [WORD_SLOTS, WORD_SLOTS, CHAR_SLOTS, CHAR_SLOTS])
    return counts.astype(np.float32) / sizes.astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray, fit: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the rows that `fit` marks (others weigh nothing, so no copy is
    made); rows of a label weigh as much as those of the other."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    cost = (fit * np.where(y == 1, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum()))).astype(np.float32)
    rate = 4.0 / max(1e-6, float(cost @ np.einsum("ij,ij->i", x, x)) + 1.0)
    for i in range(rounds):
        ww, bb = w + vw, b + vb
        g = cost * (1 / (1 + np.exp(-np.clip(x @ ww + bb, -30, 30))) - y).astype(np.float32)
        k = i / (i + 3)
        nw, nb = ww - rate * (x.T @ g + ridge * ww), bb - rate * float(g.sum())
        vw, vb, w, b = k * (nw - w), k * (nb - b), nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The classifier, from at most `sample` labelled rows; None if either label is missing."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = hash_sample(clean, "doc_id", sample)
    rows = docs.select("doc_id", text_of().cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.any_value("text").alias("text"), F.min("quality").alias("quality"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [_dense(x or b"").astype(np.float16).tobytes() for x in batch.column(0).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "key"])

    # `sample` rows of SLOTS two-byte numbers at most (49 MB at the default), which come one partition after another, sorted.
    made = map_batches(rows.select("text", F.col("quality").cast("int").alias("quality"), "key").orderBy("key"), one, "x binary, y int, key long")
    x, labels_ = np.empty((sample, SLOTS), np.float32), []
    for row in made.select("x", "y").toLocalIterator():
        x[len(labels_)] = np.frombuffer(row.x, np.float16)
        labels_.append(row.y)
        if len(labels_) == sample:  # a labelled doc_id may have many rows
            break
    if not labels_:
        return None
    x, y = x[: len(labels_)], np.array(labels_, np.float32)
    if y.min() == y.max():
        return None
    held = np.arange(len(y)) % 4 == 3
    if min(y[~held].max(), y[held].max(initial=0)) == 0 or max(y[~held].min(), y[held].min(initial=1)) == 1:
        held = np.zeros(len(y), bool)
    x *= (scale := (1.0 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-7)).astype(np.float32))  # in place: the table is the largest thing on the driver
    w, b = _logistic(x, y, ~held, 1e-3, 400)
    test = held if held.any() else ~held
    z = x @ w + b
    w = w * scale
    slope, offset = _platt(z[test].astype(float), y[test].astype(float))
    return Model(w.astype(np.float64), float(b), slope, offset)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with the five counts, whether the base rules fail it, its quality and whether it is kept; names
    are free_names of ADDED."""
    names = docs.columns
    at, more = names.index("text"), free_names(names, ADDED)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kinds = [LongType()] * 5 + [BooleanType(), DoubleType(), BooleanType()]
    schema = StructType([*docs.schema.fields, *(StructField(x, k) for x, k in zip(more, kinds))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
        base = [base_counts(x) for x in texts]
        failed = [b[0] < min_words or 100 * b[4] > 50 * b[0] for b in base]
        m = sent.value
        quality = [1.0 if m is None else m.probability(x) for x in texts]
        columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
        verdicts = [pa.array(failed, pa.bool_()), pa.array(quality, pa.float64()), pa.array([not f and q >= threshold for f, q in zip(failed, quality)], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns, *verdicts], [*names, *more])

    return map_batches(docs, one, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that the rules or the classifier reject."""
    kept = named(free_names(docs.columns, ADDED)[-1])
    return judge(docs, train(docs, labels)).where(kept).select(*map(named, docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    done = judge(docs, train(docs, labels))
    return done.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")])
