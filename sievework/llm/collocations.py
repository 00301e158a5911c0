"""Phrase collocation mining: word runs that occur more often together than their parts would explain.

Every text is cut into pieces at punctuation and line ends, pieces into words, and each run of one to max_n words becomes
a row (gram, language, occurrences). The rows of a slice of texts are summed where they are made, so that what every text
has is a row a slice, not a row a place; then they are summed by gram and language over all slices. A run that stays below
min_count is no candidate and no part of one (a part occurs at least as often as the whole), so only the others are kept,
and runs of three words or more are made rows only where both parts of a word less were kept. A Bloom filter of bounded
size tells which; what it lets through by mistake is counted and falls under the bound.

A candidate is joined, for each place it can be cut, to the counts of what stands before and after the cut; the score is
floor(1000000 a a / (l r)) in Decimal(38), exact for counts below 10^15. A candidate goes if a one-word extension of it is
a candidate with at least `share` hundredths of its count: what holds for a longer one holds for the extension between
them, which occurs at least as often. Ranks of a language are first taken in each of several hashed shares of its
candidates, of which only the first `most` go on, so that one language may hold nearly all rows.

Defined cases: a null or empty text has no words; a null lang is `und`; rows that repeat are counted each; equal score and
count are ordered by the phrase's bytes; an empty table gives an empty result; other columns are ignored, whatever their
names. A text is worked through in blocks of BLOCK bytes, so a very long one needs no more memory than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import materialize, parts, raw_texts, slices

MAX_N, MIN_COUNT, SHARE, MOST = 3, 10, 50, 2000
#: Bytes of text whose runs are summed at once, beside the longest single word.
BLOCK = 4 << 20
#: The counts' partitions are this many times the shuffle partitions: distinct runs are many times the words.
SPREAD = 3
#: Bits of a filter at most (16 MB), and bits that a key sets.
MOST_BITS, PROBES = 1 << 27, 3
#: Every character that ends a piece becomes a line feed, a tab a space.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def _blocks(text: bytes, most: int) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, with a line feed as a word between pieces, in blocks of little more than `most` bytes."""
    flat = text.lower().translate(_ENDS).replace(b"\n", b" \n ")
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + most)
        end = len(flat) if end < 0 else end
        yield [w for w in flat[at:end].split(b" ") if w]
        at = end


class Known:
    """A Bloom filter of keys: what it was made of is always held, of the rest a small share. Its bits are bounded."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def holds(self, keys: pa.Array) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(k, 42) for k in keys.cast(pa.binary()).to_pylist()], np.uint64)
        out = np.ones(len(h), bool)
        for i in range(PROBES):
            at = ((h & np.uint64((1 << 31) - 1)) + np.uint64(i) * (h >> np.uint64(33))) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def known(keys: DataFrame, most_bits: int = MOST_BITS) -> Known:
    """The filter of a table's `key`: 16 bits or more a key, until most_bits are reached; the driver gets no more than these."""
    bits = min(max(1 << 16, 1 << (16 * max(keys.count(), 1) - 1).bit_length()), most_bits)
    h = F.xxhash64("key")
    at = F.array(*[F.expr(f"((h & {(1 << 31) - 1}) + {i} * shiftrightunsigned(h, 33)) & {bits - 1}") for i in range(PROBES)])
    flat = keys.select(h.alias("h")).select(F.explode(at).alias("bit"))
    rows = flat.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return Known(words)


def _runs(words: list[bytes], old: int, low: int, high: int, lang: str, parts_known: Known | None) -> list[pa.RecordBatch]:
    """(key, n) of all runs of low to high words that end after the first `old` words; from low = 1 also of all words, under
    an empty run. With parts_known, only runs of high words both of whose parts of a word less are known."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes, table = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
    piece = codes != table.index("\n").as_py()
    # A run of n words is known by the number of its first n - 1 words and its last word.
    runs, good, out = codes, piece, []
    for n in range(1, high + 1):
        if n > 1:
            good = good[:-1] & good[1:]
            runs = runs[:-1] * len(table) + codes[n - 1 :]
        at = np.flatnonzero(good)
        if not len(at):
            break
        _, first, number = np.unique(runs[at], return_index=True, return_inverse=True)
        runs = np.full(len(good), -1, np.int64)
        runs[at] = number

        def keys(start: np.ndarray, n: int = n) -> pa.Array:
            return pc.binary_join_element_wise(pc.binary_join_element_wise(*(table.take(pa.array(codes[start + j])) for j in range(n)), " "), lang, "\t")

        if n >= low:
            many = np.bincount(number, weights=at + n > old).astype(np.int64)
            new = np.flatnonzero(many)
            out.append(pa.RecordBatch.from_arrays([keys(at[first[new]]), pa.array(many[new])], ["key", "n"]))
        elif parts_known is not None and n == high - 1:
            good = good.copy()
            good[at] = parts_known.holds(keys(at[first]))[number]
    total = int(piece[old:].sum()) if low == 1 else 0
    return [*out, pa.RecordBatch.from_arrays([pa.array(["\t" + lang]), pa.array([total])], ["key", "n"])] if total else out


def exploded(docs: DataFrame, low: int = 1, high: int = MAX_N, parts_known: Known | None = None, block: int = BLOCK) -> DataFrame:
    """(key, n): every run of low to high words of every text, with its language after a tab, summed by slices of texts.

    With low = 1, the rows of an empty run have all words of a language; with parts_known, runs with an unknown part go.
    """
    sent = None if parts_known is None else docs.sparkSession.sparkContext.broadcast(parts_known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    tail: list[bytes] = []
                    for words in _blocks(b"\n".join(own), block):
                        for out in _runs(tail + words, len(tail), low, high, lang, sent and sent.value) if words else ():
                            yield from pa.Table.from_batches([out]).to_batches(max_chunksize=1 << 16)
                        tail = (tail + words)[-(high - 1) :] if high > 1 else []

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key string, n long")


def counted(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, gram, order, n) of the runs found min_count times or more; the order of all words of a language is 0.

    Words and pairs are counted first. A longer run is only made a row where both its parts of a word less are among those
    found min_count times: it occurs no more often than they do, so nothing that counts is left out.
    """

    def often(rows: DataFrame, label: str) -> DataFrame:
        found = rows.repartition(SPREAD * parts(docs.sparkSession), "key").groupBy("key").agg(F.sum("n").alias("n"))
        return materialize(found.where((F.col("n") >= min_count) | F.col("key").startswith("\t")), label)

    levels = [often(exploded(docs, 1, min(max_n, 2)), "grams-2")]
    for n in range(3, max_n + 1):
        pairs = levels[-1].where(F.size(F.split(F.substring_index("key", "\t", 1), " ")) == n - 1) if n == 3 else levels[-1]
        levels.append(often(exploded(docs, n, n, known(pairs)), f"grams-{n}"))
    found = reduce(DataFrame.unionByName, levels)
    gram = F.substring_index("key", "\t", 1)
    order = F.when(gram == "", F.lit(0)).otherwise(F.size(F.split(gram, " ")))
    return found.select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"), gram.alias("gram"), order.alias("order"), "n")


def _joined(words: Column, first: Column | int, many: Column | int) -> Column:
    return F.array_join(F.slice(words, first, many), " ")


def scored(counts: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(lang, gram, order, a, l, r, score) of every candidate, cut where its score is lowest, then where it is cut first."""
    words = F.split("gram", " ")
    cuts = counts.where("order >= 2").select("lang", "gram", "order", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("order") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", _joined(words, 1, F.col("cut"))).withColumn("rest", _joined(words, F.col("cut") + 1, F.col("order") - F.col("cut")))
    heads = counts.select("lang", F.col("gram").alias("head"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    top = F.lit(scale).cast("decimal(7,0)") * (exact("a") * exact("a"))
    both = both.withColumn("top", top).withColumn("bottom", (exact("l") * exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("top div bottom"))
    least = both.groupBy("lang", "gram").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"), F.first("order").alias("order"), F.first("a").alias("a"))
    return least.select("lang", "gram", "order", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))


def not_absorbed(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates (with lang, gram, order, a) without those of which a one-word extension has `share` hundredths."""
    words = F.split("gram", " ")
    held = F.array(_joined(words, 1, F.col("order") - 1), _joined(words, 2, F.col("order") - 1))
    longer = candidates.where("order >= 3").select(F.col("lang").alias("in_lang"), F.explode(held).alias("inner"), F.col("a").alias("b"))
    longer = longer.groupBy("in_lang", "inner").agg(F.max("b").alias("b"))
    same = (F.col("lang") == F.col("in_lang")) & (F.col("gram") == F.col("inner"))
    return candidates.join(longer, same & (100 * F.col("b") >= share * F.col("a")), "left_anti")


def ranked(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` candidates of each language, with rank."""
    order = (F.desc("score"), F.desc("a"), F.asc("gram"))
    share = F.pmod(F.xxhash64("gram"), F.lit(parts(candidates.sparkSession))).cast("int")
    first = candidates.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    first = first.where(F.col("at") <= most).drop("share", "at")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to max_n words."""
    counts = counted(docs, max_n, min_count)
    best = ranked(not_absorbed(materialize(scored(counts), "phrases"), share), most)
    totals = counts.where("order = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 2000 best phrases of two or three words of each language."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, o, gram, count(*) AS f FROM (
    SELECT lang, 1 AS o, unnest(w) AS gram FROM pieces
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE o = 1 GROUP BY lang),
split AS (
  SELECT lang, o, gram, f, k, array_to_string(list_slice(ws, 1, k), ' ') AS head, array_to_string(list_slice(ws, k + 1, o), ' ') AS rest
  FROM (SELECT *, string_split(gram, ' ') AS ws, unnest(range(1, o)) AS k FROM grams WHERE o > 1 AND f >= 10)),
cuts AS (
  SELECT s.lang, s.o, s.gram, s.f AS a, s.k, h.f AS l, r.f AS r, ((1000000::HUGEINT * s.f * s.f) // (h.f::HUGEINT * r.f))::BIGINT AS score
  FROM split s JOIN grams h ON h.lang = s.lang AND h.gram = s.head JOIN grams r ON r.lang = s.lang AND r.gram = s.rest),
candidates AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
longer AS (
  SELECT lang, gram, max(f) AS f FROM (
    SELECT lang, array_to_string(list_slice(string_split(gram, ' '), 1, 2), ' ') AS gram, a AS f FROM candidates WHERE o = 3
    UNION ALL SELECT lang, array_to_string(list_slice(string_split(gram, ' '), 2, 3), ' '), a FROM candidates WHERE o = 3)
  GROUP BY lang, gram),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer g ON g.lang = c.lang AND g.gram = c.gram AND 100 * g.f >= 50 * c.a WHERE g.gram IS NULL)
SELECT lang, rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM (SELECT lang, gram, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram)::BIGINT AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""
