"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash space is retained.

Because the threshold is the same for all documents, sketches of parts merge into the sketch of the whole, and the share
of one sketch that lies in another estimates containment however unequal the documents are. Texts are lower-cased, split
at blanks, and shingled by five words (a shorter text is one shingle). A text's fingerprint is a hash of all its words
followed by its sketch; equal texts have equal fingerprints.

All work is DataFrame functions. The edited text needs the next document by descending doc_id: documents are dealt by
ranges of (doc_id, hash of the text), whose edges come from a sample, so that a doc_id with many rows is split too; each
range's first row is also sent, as a guest, to the range that comes before it, and one window inside each range reads the
next row. The texts are shuffled once.

Defined cases: a null or empty text has no words, an empty sketch, and the fingerprint of no words; likeness of two
empty sketches is 1 if the fingerprints are equal and else 0; rows that share a doc_id follow each other by a hash of the
text, null doc_ids come last; a single document is its own next; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import BLANKS, MOST_SAMPLED, find_edge, hash_sample, parts, text_of

SHINGLE = 5
#: One hash in this many is retained.
ONE_IN = 4
#: Ranges for each shuffle partition, and rows sampled for each range; they only steer the dealing.
RANGES_PER_PARTITION, SAMPLED_PER_RANGE = 8, 8
LEAST = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def shingle_hashes(hashes: Column, k: int = SHINGLE) -> Column:
    """Hash of each run of k word hashes; of all of them if there are fewer."""
    n = F.size(hashes)
    some = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, some).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def sketch(shingles: Column, one_in: int = ONE_IN) -> Column:
    """The distinct hashes below the threshold, sorted."""
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda h: h < F.lit(LEAST + (1 << 64) // one_in))))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together (but for shingles across their border)."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has, from their sketches; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def resemblance(a: Column, b: Column, same: Column) -> Column:
    """Jaccard likeness from two sketches; `same` decides where both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(same, F.lit(1.0)).when(every == 0, F.lit(0.0)).otherwise(both / every)


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def printed(words_hash: Column, sketch_: Column) -> Column:
    """The fingerprint as a string: a hash of all words, then the sketch."""
    return F.concat(_hex(words_hash), F.lit(":"), F.array_join(F.transform(sketch_, _hex), ""))


def _sketched(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds {to}_p, a hash of all words, and {to}_s, the sketch."""
    df = df.withColumn(f"{to}_h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return df.withColumn(f"{to}_s", sketch(shingle_hashes(F.col(f"{to}_h")))).withColumn(f"{to}_p", F.xxhash64(f"{to}_h")).drop(f"{to}_h")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, own_s, own_p, next_s, next_p): each row with the next one by descending doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    rows = rows.withColumn("k", F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("id"), F.xxhash64("text").alias("text")))
    ranges = RANGES_PER_PARTITION * parts(spark)
    keys = sorted((r.k.id, r.k.text) for r in hash_sample(rows.select("k"), "k", min(MOST_SAMPLED, ranges * SAMPLED_PER_RANGE)).collect())
    edges = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    kind = "struct<id:bigint,text:bigint>"
    placed = rows.withColumn("range", find_edge(edges, F.col("k"), lambda e: F.struct(F.lit(e[0]).alias("id"), F.lit(e[1]).alias("text"))))
    # The greatest key of each range that has rows: as many pairs of numbers as there are ranges.
    tops = {r.range: (r.top.id, r.top.text) for r in placed.groupBy("range").agg(F.max("k").alias("top")).collect()}
    filled = sorted(tops)
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    pair = lambda e: F.lit(None).cast(kind) if e is None else F.struct(F.lit(e[0]).cast("long").alias("id"), F.lit(e[1]).cast("long").alias("text"))
    top = F.array(*[pair(tops.get(i)) for i in range(len(edges) + 1)])
    to = F.array(*[F.lit(above.get(i)).cast("int") for i in range(len(edges) + 1)])
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    also = F.struct(F.get(to, F.col("range")).alias("range"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("k") == F.get(top, F.col("range")), F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "k", F.col("at.range").alias("range"), F.col("at.guest").alias("guest")).repartition(parts(spark), "range")
    order = Window.partitionBy("range").orderBy("guest", F.col("k").desc(), "text")
    marked = _sketched(dealt, "text", "own")
    for name, to_ in (("text", "next_text"), ("own_s", "next_s"), ("own_p", "next_p")):
        marked = marked.withColumn(to_, F.lead(name).over(order))
    return marked.where("guest = 0").drop("k", "range", "guest")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of all documents and their edited texts, and likenesses."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = _sketched(rows, "edited", "edited")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own_p"), F.col("own_s")).alias("fingerprint"),
        printed(F.col("edited_p"), F.col("edited_s")).alias("edited_fingerprint"),
        resemblance(F.col("own_s"), F.col("edited_s"), F.col("own_p") == F.col("edited_p")).alias("near_edited"),
        resemblance(F.col("own_s"), F.col("next_s"), F.col("own_p") == F.col("next_p")).alias("near_next"),
        containment(F.col("own_s"), F.col("edited_s")).alias("held_by_edited"),
        containment(F.col("edited_s"), F.col("own_s")).alias("held_of_edited"),
    )
