"""A join of texts with a table of patterns: the matching pattern of the lowest priority, without trying all pairs.

Each pattern comes with words of which any text that matches has at least one as the start of a word (`starts`). The index
is a table (first letters of a start, pattern); a text's words are looked up in it by an equi-join that moves letters and
row numbers, not texts; what remains are a few candidates for each text, and only these are tried as regular expressions.
First letters say little where starts are common words; with `pairs`, a start is two whole words with a blank between, of
which any text that matches has at least one as neighbours, and the index is one of pairs.
A text without a match gets the family that a table of substrings names for it (by the substrings' order), or else a default.

Defined cases: a null text matches nothing; a pattern without starts is tried on every text; equal priorities are decided
by family and pattern; a pattern that is in the table twice counts once; rows that repeat are kept each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word's start that the index is kept by.
LETTERS = 3
#: Substrings that are tried in one expression at most; patterns without starts likewise.
BOUND = 1000


def _stems(text: Column) -> Column:
    """The distinct first letters of a text's words, of one up to LETTERS of them."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in range(1, LETTERS + 1)]))))


def _pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text, over a column of its words."""
    return F.array_distinct(F.transform(text, lambda w, i: F.concat(w, F.lit(" "), F.get(text, i + 1))))


def index(patterns: DataFrame, pairs: bool = False) -> DataFrame:
    """(stem, pattern_id) of patterns (with pattern_id, starts)."""
    starts = patterns.select("pattern_id", F.explode("starts").alias("start"))
    return starts.select((F.lower("start") if pairs else F.substring(F.lower("start"), 1, LETTERS)).alias("stem"), "pattern_id").distinct()


def candidates(rows: DataFrame, key: str, text: str, patterns: DataFrame, pairs: bool = False) -> DataFrame:
    """(key, pattern_id): the patterns that the index does not rule out for a row's text."""
    # explode_outer: of explode() Spark infers a filter that computes the stems once more.
    if pairs:
        words = rows.select(key, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+").alias("_words"))
        stems = words.select(key, F.explode_outer(_pairs(F.col("_words"))).alias("stem"))
    else:
        stems = rows.select(key, F.explode_outer(_stems(F.col(text))).alias("stem"))
    return stems.join(index(patterns, pairs), "stem").select(key, "pattern_id").distinct()


def first_family(rows: DataFrame, key: str, text: str, patterns: DataFrame, substrings: list[tuple[str, str]] = (), default: str | None = None, pairs: bool = False) -> DataFrame:
    """rows (of distinct keys) and family, by patterns (family, priority, pattern, starts array<string>, each two words if `pairs`), then substrings, then the default."""
    if len(substrings) > BOUND:
        raise ValueError(f"more than {BOUND} substrings")
    known = patterns.select("family", F.col("priority").cast("long").alias("priority"), "pattern", F.coalesce("starts", F.array().cast("array<string>")).alias("starts"))
    known = known.groupBy("family", "priority", "pattern").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    known = known.withColumn("pattern_id", F.xxhash64("family", "priority", "pattern"))
    rule = F.struct("priority", "family", "pattern")
    found = candidates(rows, key, text, known.where(F.size("starts") > 0), pairs).join(known.select("pattern_id", rule.alias("rule")), "pattern_id")
    found = found.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list("rule")).alias("_rules"))
    loose = known.where(F.size("starts") == 0).select(rule.alias("rule")).limit(BOUND + 1).agg(F.collect_list("rule").alias("all"))
    kind = loose.schema["all"].dataType
    always = loose.select(F.when(F.size("all") > BOUND, F.raise_error(F.lit("too many patterns without starts")).cast(kind)).otherwise(F.col("all"))).scalar()
    part = F.coalesce(*[F.when(F.contains(F.lower(F.col(text)), F.lit(x)), F.lit(family)) for x, family in substrings], F.lit(default))
    joined = rows.join(found, F.col(key) == F.col("_key"), "left").withColumn("_always", always)
    joined = joined.withColumn("_rules", F.array_sort(F.concat(F.coalesce("_rules", F.array().cast(kind)), F.coalesce("_always", F.array().cast(kind)))))
    hit = F.get(F.filter("_rules", lambda r: F.call_function("rlike", F.col(text), r["pattern"])), F.lit(0))
    return joined.withColumn("family", F.coalesce(hit["family"], part)).drop("_key", "_rules", "_always")
