"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n), bucketed and sorted by hash: n documents of the run's batches hold a line of that key. Each
new batch brings its documents' distinct line hashes (all texts are hashed in one reading), leaves out (merge anti-join) the keys that earlier runs already settled
as common, and adds the rest as a run of level 0. When a level holds `fanout` runs they are compacted into one run of the
next level: buckets are merged as they lie, without a new shuffle, counts of equal keys are summed, and keys that reach
the threshold move to the settled run. Totals over all runs are exact, so the common keys are those of exactly the lines
found in at least `min_docs` documents. Those lines go from every document.

A line's key is the line with space and the ASCII controls from tab to carriage return stripped at both ends and A-Z
lower-cased; keys shorter than `min_chars` code points are never dropped. Keys are compared by 128 bits of XXH3.

Dropping has two ways. If the common keys are at most `broadcast_keys`, they go to all executors and each document is
filtered where it is read. Beyond that the documents' line hashes are joined to the runs, hits are gathered for each
distinct text (known by 128 bits of hash) and joined to the texts.

Defined cases: a null or empty text is one empty line; rows are documents even if they repeat or share a doc_id; an
empty table gives an empty result; other columns are kept by dedup_lines, whose two added columns get underscores more
where such a name is taken, and ignored by the contract query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import drop, free_names, map_batches, materialize, named, only, sorted_run

BLANK = b" \t\n\x0b\x0c\r"
#: 16 bytes each, so at most 8 MB to an executor.
BROADCAST_KEYS = 500_000
#: Above the fanout of two, so that later batches are anti-joined with what the first ones settled.
BATCHES = 4
#: Names of the columns that dedup_lines adds.
COUNTS = ["_n_lines", "_n_dropped"]


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None where the key is too short to be dropped."""
    digest = xxhash.xxh3_128_digest
    keys = [x.strip(BLANK) for x in text.lower().split(b"\n")]
    if min_chars <= 1:
        return [digest(k) if k else None for k in keys]
    return [digest(k) if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _hash_columns(raw: bytes | bytearray) -> list[np.ndarray]:
    """16-byte keys one after another as two columns of signed 64-bit numbers."""
    both = np.frombuffer(raw, ">i8").reshape(-1, 2)
    return [both[:, i].astype(np.int64) for i in range(2)]


def _hashed(docs: DataFrame, min_chars: int, batch_of: Column | None = None) -> DataFrame:
    """(batch, h1, h2, n): how many documents of each batch of a slice hold each key; all are batch 0 unless told."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, dict[bytes, int]] = {}
        for b, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            own = seen.setdefault(b, {})
            for k in set(line_keys(text.as_py() or b"", min_chars)):
                if k is not None:
                    own[k] = own.get(k, 0) + 1
        size = [len(own) for own in seen.values()]
        numbers = pa.array(np.repeat(list(seen), size).astype(np.int32)), pa.array([n for own in seen.values() for n in own.values()], pa.int64())
        return pa.RecordBatch.from_arrays([numbers[0], *map(pa.array, _hash_columns(b"".join(k for own in seen.values() for k in own))), numbers[1]], ["batch", "h1", "h2", "n"])

    rows = docs.select((F.lit(0) if batch_of is None else batch_of).cast("int").alias("batch"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "batch int, h1 long, h2 long, n long")


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None

    def _run(self, rows: DataFrame, label: str = "line_run") -> DataFrame:
        return sorted_run(rows, label, ["h1", "h2"])

    def add(self, batch: DataFrame) -> None:
        """Adds one batch of documents; each of its rows must be added once."""
        self.add_hashed(_hashed(batch, self.min_chars))

    def add_hashed(self, hashed: DataFrame) -> None:
        """Adds one batch whose lines are hashed (h1, h2, n)."""
        rows = hashed.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        if self.settled is not None:
            rows = rows.join(self.settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._run(rows))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The runs as one, by merge joins of their buckets."""
        out = runs[0]
        for run in runs[1:]:
            other = run.withColumnRenamed("n", "m").hint("merge")
            out = out.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self.levels[level] = []
        merged = self._run(self._merged(old))
        common = merged.where(F.col("n") >= self.min_docs).select("h1", "h2")
        was = self.settled
        self.settled = self._run(common if was is None else common.join(was.hint("merge"), ["h1", "h2"], "full_outer"), "line_settled")
        for run in [*old, was]:
            drop(run)
        # Settled keys stay in the run that settled them, and are left out wherever it is read.
        self._put(level + 1, only(merged, F.col("n") < self.min_docs))

    def common(self) -> DataFrame:
        """(h1, h2) of every key found in at least min_docs documents."""
        runs = [run for level in self.levels for run in level]
        found = self._merged(runs).where(F.col("n") >= self.min_docs).select("h1", "h2")
        return found if self.settled is None else found.join(self.settled.hint("merge"), ["h1", "h2"], "full_outer")


def _kept(text: bytes, common: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    stay = [x for x, k in zip(lines, line_keys(text, min_chars)) if k is None or k not in common]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def drop_common(docs: DataFrame, common: DataFrame, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with the text rewritten and two more columns (free_names of COUNTS): every line whose key is in `common` goes."""
    spark = docs.sparkSession
    names = docs.columns
    at, more = names.index("text"), free_names(names, COUNTS)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in more)])

    def rewrite(batch: pa.RecordBatch, sets: Iterable[set[bytes]]) -> pa.RecordBatch:
        done = [_kept(t.as_py() or b"", s, min_chars) for t, s in zip(batch.column(at).cast(pa.binary()), sets)]
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array([x[0] for x in done], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], [*names, *more])

    if common.count() <= broadcast_keys:
        rows = common.select("h1", "h2").toArrow()  # checked above: at most broadcast_keys pairs of numbers
        flat = np.stack([rows.column(i).to_numpy() for i in range(2)], axis=1).astype(">i8").tobytes()
        sent, label = spark.sparkContext.broadcast(flat), uuid.uuid4().hex

        def near(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = _unpacked(label, sent.value)
            return rewrite(batch, (every for _ in range(batch.num_rows)))

        return map_batches(docs, near, schema)

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, raw = [], bytearray()
        for text in batch.column(2).cast(pa.binary()):
            own = {k for k in line_keys(text.as_py() or b"", min_chars) if k is not None}
            size.append(len(own))
            raw += b"".join(own)
        ids = [pa.array(np.repeat(batch.column(i).to_numpy(), size)) for i in range(2)]
        return pa.RecordBatch.from_arrays([*ids, *map(pa.array, _hash_columns(raw))], ["t1", "t2", "h1", "h2"])

    # A text's hits follow from the text, so equal texts share them, and each is hashed once.
    same = [F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))]
    lines = map_batches(docs.select(same[0].alias("t1"), same[1].alias("t2"), "text"), hashes, "t1 long, t2 long, h1 long, h2 long").distinct()
    hits = lines.join(common, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))
    t1, t2, found = free_names(names, ["t1", "t2", "hits"])
    hits = hits.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("hits").alias(found))
    joined = docs.withColumn(t1, same[0]).withColumn(t2, same[1]).join(hits, [t1, t2], "left").select(*map(named, names), found)

    def far(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = ({np.array([(x["h1"], x["h2"])], ">i8").tobytes() for x in hit.as_py() or []} for hit in batch.column(len(names)))
        return rewrite(batch, sets)

    return map_batches(joined, far, schema)


_CACHE: dict[str, set[bytes]] = {}


def _unpacked(label: str, flat: bytes) -> set[bytes]:
    """The broadcast keys as a set, built once for each worker."""
    if label not in _CACHE:
        _CACHE.clear()
        _CACHE[label] = {flat[i : i + 16] for i in range(0, len(flat), 16)}
    return _CACHE[label]


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of the lines found in at least min_docs rows of docs, fed to the runs batch by batch.

    Texts are hashed in one reading, to a table by batch, from which the batches are added.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    deal = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(batches))
    hashed = materialize(_hashed(docs, min_chars, deal), "line-hashes", ["batch"])
    for b in range(batches):
        runs.add_hashed(hashed.where(F.col("batch") == b))
    drop(hashed)
    return materialize(runs.common(), "line-common")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs, all columns, with every common line gone from its text, and two more: free_names of COUNTS."""
    return drop_common(docs, common_lines(docs, min_docs, min_chars, batches), min_chars, broadcast_keys)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: lines found in at least 10 documents go from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs, min_docs=10, min_chars=1)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT row_id, doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_id, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), E'\n') AS parts FROM documents))),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY row_id, doc_id
"""
