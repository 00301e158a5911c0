"""Best-fit packing of token sequences, bulk-synchronous.

Documents longer than a sequence are cut from their end into full pieces; only the first piece may be shorter. Pieces are
sorted by length and ranked within it, so a piece is known by (length, rank); gaps, the room left in open sequences, are
sorted the same way. Both are kept as runs: pieces of one length with consecutive ranks, equal gaps with consecutive
sequence numbers. So the tables that the rounds move are bounded by the sequence length, not by the corpus.

A round deals pieces and gaps into ranges of size and sweeps each range upwards, as brackets are matched: a piece opens,
and a gap closes the longest waiting piece that it holds, which makes that gap the piece's successor. Where several pieces
of a length and several equal gaps meet, the piece of rank r takes the r-th gap, so no two want the same one. A gap takes
one piece a round, or several equal ones where it holds them MANY times. Used gaps shrink and are dealt anew; a gap that
found nothing in its range goes to the next lower one; pieces longer than every gap open sequences, the longest first, as
many as the rest needs at least. Rounds repeat until no piece is left. Lengths come in bands, the long ones first, so that
short pieces fill what long ones leave; a band goes on while a round places a good part of its pieces, and the few that
are left go on with the next. The plan is joined to the ranked pieces.

Defined cases: a null or empty text is the end token alone; rows that share a doc_id are packed each (their pieces tie by
length and checksum); the string of an added token is that token (<|endoftext|> is one id); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.bpe import RANKS, load_ranks
from sievework.llm.common import drop, find_edge, map_batches, materialize, parts

SIZE, END = 1024, 2
#: Bands of lengths end at the size divided by these; ranges that lengths are dealt into; how many times a gap must hold a
#: piece to take several; a band is left when a round places less than one in so many of its pieces.
BANDS, RANGES, MANY, WORTH = (2, 4, 16), 2, 4, 20
#: Rows of the plan that are broadcast at most (48 bytes each).
BROADCAST_PLAN = 200_000

#: The tokenizer whose ids the contract fixes.
TOKENIZER = "byte_bpe_50k.json"

@cache
def _added(path: str) -> tuple[str, ...]:
    """The strings of a tokenizer file's added tokens, without reading its vocabulary."""
    with open(path, encoding="utf-8") as lines:
        text = lines.read()
    found, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
    return tuple(x["content"] for x in found)


@cache
def _library(path: str):
    """The tokenizers library on a tokenizer file; only a text that holds an added token's string needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranked(path: str):
    """The ranks as a tiktoken encoding.

    The rank file and the tokenizer file hold one vocabulary (a test compares their ids); ranks encode several times
    faster. They know no added tokens: text_ids() has those.
    """
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def text_ids(text: str, path: str) -> bytes:
    """The library's ids of a text, as bytes: by ranks, or by the library itself where an added token's string occurs."""
    file = public_tokenizers.path(TOKENIZER)
    if any(x in text for x in _added(file)):
        return np.array(_library(file).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return np.array(_ranked(path).encode_ordinary(text), "<u4").tobytes()


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first."""
    first = length % size or min(size, length)
    return [(0, first)] + [(at, size) for at in range(first, length, size)]


def tokenized(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    tail = np.array([end], "<u4").tobytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = memoryview(text_ids(text.as_py() or "", path) + tail)
            out += [(doc, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, size))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECE, GAP, PLACED = 0, 1, 2
#: Runs: kind, length of pieces or room of gaps, the size that it is dealt by, first rank or sequence, how many; of placed
#: pieces also the first sequence and the offset.
RUNS = "kind int, size long, at long, first long, many long, sequence long, offset long"


def _swept(batches: Iterator[pa.RecordBatch], size: int, low: int, width: int) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by (range, at, kind): what is left of the pieces, the gaps after the sweep, and what was placed."""
    out: list[tuple] = []
    stack: list[list[int]] = []  # pieces that wait: length, first rank, how many
    where = None

    def close() -> None:
        out.extend((PIECE, n, n, first, many, None, None) for n, first, many in stack)
        stack.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] != where:
                close()
                where = row["range"]
            n, first, many = row["size"], row["first"], row["many"]
            if row["kind"] == PIECE:
                stack.append([n, first, many])
                continue
            while many and stack:
                top = stack[-1]
                each = min(n // top[0], top[2]) if n >= MANY * top[0] else 1
                used = min(many, top[2] // each)
                out.extend((PLACED, top[0], None, top[1] + j * used, used, first, size - n + j * top[0]) for j in range(each))
                out.append((GAP, n - each * top[0], n - each * top[0], first, used, None, None))
                top[1], top[2] = top[1] + each * used, top[2] - each * used
                first, many = first + used, many - used
                if not top[2]:
                    stack.pop()
            if many:
                out.append((GAP, n, low + where * width, first, many, None, None))
    close()
    if out:
        names = ("kind", "size", "at", "first", "many", "sequence", "offset")
        kinds = (pa.int32(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(names))


def plan_of(spark: SparkSession, counts: dict[int, int], size: int = SIZE) -> DataFrame:
    """(length, first_rank, many, sequence, offset): `many` pieces of the length, from a rank on, go to consecutive
    sequences from `sequence` on, each at the offset. `counts` has how many pieces there are of each length."""
    fresh = counts.get(size, 0)
    own = [(PLACED, size, None, 0, fresh, 0, 0)] if fresh else []  # what the driver places: full pieces and openings
    tables: list[DataFrame] = []
    gaps: DataFrame | None = None
    every = {n: (0, many) for n, many in counts.items() if 0 < n < size and many}  # first rank and how many: a run a length
    for low in [size // x for x in BANDS] + [0]:
        width, worth = max(1, -(-(size - 1 - low) // RANGES)), True
        reset, top = True, size
        while worth and any(n > low for n in every):
            pieces = {n: run for n, run in every.items() if n > low}
            waiting = sum(many for _, many in pieces.values())
            # Pieces that are longer than every gap that is still dealt: the longest open sequences.
            unfit = sum(many for n, (_, many) in pieces.items() if n > top or gaps is None)
            if unfit:
                long = sum(many for n, (_, many) in pieces.items() if 2 * n > size)
                left = min(unfit, max(long, -(-sum(n * many for n, (_, many) in pieces.items()) // size)))
            else:
                left = 0
            opened = []
            for n in sorted(pieces, reverse=True):
                if not left:
                    break
                first, many = pieces.pop(n)
                used = min(left, many)
                own.append((PLACED, n, None, first, used, fresh, 0))
                opened.append((GAP, size - n, size - n, fresh, used, None, None))
                fresh, left = fresh + used, left - used
                if many > used:
                    pieces[n] = (first + used, many - used)
            rows = spark.createDataFrame([(PIECE, n, n, first, many, None, None) for n, (first, many) in pieces.items()] + opened, RUNS).coalesce(1)
            if gaps is not None:
                rows = rows.unionByName(gaps.withColumn("at", F.col("size")) if reset else gaps)
            # A gap is dealt by the longest length of pieces, of those there are, that it holds; without one it waits.
            lengths = sorted(pieces)
            at = F.coalesce(F.get(F.array(F.lit(0), *map(F.lit, lengths)), find_edge(lengths, F.col("at"))), F.lit(0)).cast("long")
            rows = rows.withColumn("at", at).withColumn("range", F.when(F.col("at") > 0, F.floor((F.col("at") - low - 1) / width)).otherwise(-1).cast("int"))
            dealt = rows.where("range >= 0").repartition(RANGES, "range").sortWithinPartitions("range", "at", "kind", "size", "first")
            swept = dealt.mapInArrow(lambda it, low=low, width=width: _swept(it, size, low, width), RUNS)
            seen = Observation()
            out = swept.unionByName(rows.where("range < 0").drop("range")).observe(seen, F.max(F.when(F.col("kind") == GAP, F.col("at"))).alias("top"))
            out = materialize(out, "pack-round")
            tables.append(out)
            # One run of pieces for each length: at most `size` rows.
            rest = {r.size: (r.first, r.many) for r in out.where(F.col("kind") == PIECE).collect()}
            every = {n: run for n, run in every.items() if n <= low} | rest
            gaps, reset, top = out.where((F.col("kind") == GAP) & (F.col("size") > 0)), False, seen.get["top"] or 0
            worth = low == 0 or WORTH * (waiting - sum(many for _, many in rest.values())) >= waiting
    placed = spark.createDataFrame(own, RUNS).coalesce(1)
    placed = reduce(lambda a, b: a.unionByName(b), [placed, *(t.where(F.col("kind") == PLACED) for t in tables)])
    done = materialize(placed.select(F.col("size").alias("length"), F.col("first").alias("first_rank"), "many", "sequence", "offset").coalesce(1), "pack-plan")
    for t in tables:
        drop(t)
    return done


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) and their sequence_id and offset."""
    spark = pieces.sparkSession
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts(spark))).cast("int")
    dealt = materialize(pieces.withColumn("deal", deal), "pieces")
    counts = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    per_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = plan_of(spark, per_length, size).withColumnRenamed("length", "plan_length")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_PLAN else plan
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("l"), F.col("deal").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(place) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("l")) & (F.col("deal") == F.col("d"))).withColumn("rank", F.col("base") + F.col("place"))
    found = ranked.join(plan, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many")))
    return found.select(*pieces.columns, (F.col("sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all rows of docs, cut and packed."""
    return pack(tokenized(docs, path or public_tokenizers.path(RANKS), size, end), size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
