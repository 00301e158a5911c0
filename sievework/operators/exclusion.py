"""Chained exclusion: rows that several held-out sources know by one of several keys go.

Nearly all rows of a large table are held out by no source. So each key's held-out values first become a Bloom filter of a
fixed number of bits, built by one aggregation and read as a scalar; a row that no filter may know stays where it was read.
Only the others, the suspects, are moved for the exact anti joins, one after another. A filter can be wrong in one way
only, so the result is exact at any size; a filter that is too small for its keys lets more rows be suspects.

Defined cases: a null key is held out by nothing, and null among the held-out values holds nothing out; repeated rows stay
each; an empty source holds nothing out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (one scalar of an eighth of that in bytes), and bits set for each key.
BITS, PROBES = 1 << 21, 4


def _places(key: Column, bits: int, probes: int) -> list[Column]:
    """The bits of a key: two hashes combined, as often as there are probes."""
    first, step = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    low = lambda h: F.pmod(h, F.lit(1 << 31))
    return [F.pmod(low(first) + F.lit(i) * low(step), F.lit(bits)) for i in range(probes)]


def bloom(keys: DataFrame, bits: int = BITS, probes: int = PROBES) -> Column:
    """The filter of a one-column table as a scalar: an array of 64-bit words. Nulls are left out."""
    (name,) = keys.columns
    at = keys.where(F.col(name).isNotNull()).select(F.explode(F.array(*_places(F.col(name), bits, probes))).alias("bit"))
    words = at.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    listed = every.join(words, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set")))).alias("all"))
    return listed.select(F.transform("all", lambda x: x["set"]).alias("words")).scalar()


def may_hold(words: Column, key: Column, bits: int = BITS, probes: int = PROBES) -> Column:
    """Whether the filter may know the key: never false for a key that it was made of; false for null."""
    tests = []
    for place in _places(key, bits, probes):
        word = F.get(words, F.floor(place / 64).cast("int"))
        tests.append(F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out & key.isNotNull(), F.lit(False))


def chained_anti(rows: DataFrame, held: dict[str, DataFrame], bits: int = BITS) -> DataFrame:
    """rows without those of which any of the keys (a column of rows: a one-column table of values) is held out."""
    suspect = F.lit(False)
    for key, values in held.items():
        suspect = suspect | may_hold(bloom(values, bits), F.col(key), bits)
    some = rows.where(suspect)
    for key, values in held.items():
        (name,) = values.columns
        some = some.join(values.select(F.col(name).alias("_held")).distinct(), F.col(key) == F.col("_held"), "left_anti")
    return rows.where(~suspect).unionByName(some)
