"""What the operators of this subpackage share: shared-folder tables, words, binary search over edges."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points that separate words: space and the five ASCII controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Keys that are sampled for the edges of ranges at most, whatever the number of partitions.
MOST_SAMPLED = 1 << 18
#: Bytes of text that a Python function gets at once, beside the longest single text.
SLICE_BYTES = 4 << 20
#: Spark's setting that frees a query's shuffle files at its end.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it has ended, and not when the driver next collects its garbage. Only
    for queries whose result is written: a DataFrame that is itself run again would shuffle again."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES, before) if before is not None else spark.conf.unset(FREES)


@contextmanager
def unbroadcast(spark: SparkSession) -> Iterator[None]:
    """Inside, no side of a join is gathered in the driver, however small: many queries in a row, each with relations that
    the driver builds and holds until it next collects its garbage, take more of its memory than any one of them."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, was in zip(names, before):
            spark.conf.set(n, was) if was is not None else spark.conf.unset(n)


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: a cut of the lineage that survives lost executors.

    With `by`, the table lies in a folder for each value of these columns, so that a test of them reads no other.

    The folder goes when the driver's JVM ends; drop() removes it before that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievework/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievework_path = path
    return out


def sorted_run(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Like materialize(), but in as many buckets as there are shuffle partitions, each sorted by the keys: joins and sums
    of such tables by these keys need no shuffle."""
    spark = rows.sparkSession
    name = f"sievework_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/sievework/{name}"
    with shuffles_freed(spark):
        rows.write.bucketBy(parts(spark), *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.table(name)
    out._sievework_path, out._sievework_table = path, name
    return out


def only(table: DataFrame, test: Column) -> DataFrame:
    """The rows of a written table that pass the test; drop() of them removes the table."""
    out = table.where(test)
    out._sievework_path, out._sievework_table = getattr(table, "_sievework_path", None), getattr(table, "_sievework_table", None)
    return out


def drop(df: DataFrame | None) -> None:
    """Removes a table that materialize() or sorted_run() wrote, once nothing reads it any more."""
    path = getattr(df, "_sievework_path", None)
    if table := getattr(df, "_sievework_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does the same, faster, where there are only ASCII characters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def find_edge(edges: list, value: Column, made: Callable[[object], Column] = F.lit) -> Column:
    """How many of the sorted edges are <= value, by binary search over an array literal; `made` makes one edge a column."""
    if not edges:
        return F.lit(0)
    table, steps = F.array(*map(made, edges)), len(edges).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(table, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the first by the hash of the key.

    A threshold on the hash, from the number of rows, leaves little more than n of them, so that no task sends n rows to
    the last one (unless one key has most rows; then each still sends n at most). All rows are used if there are at most n.
    """
    total = rows.count()
    if total > n:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, (n + 6 * n**0.5 + 64) / total)) + 1)
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(n)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text in an Arrow column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, each with underscores before it until no column has it (Spark ignores case in names)."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row (maps apart, which have none), that tells null from any value."""
    own = [named(c) for c, kind in docs.dtypes if "map<" not in kind]
    return F.xxhash64(*own, *(x.isNull() for x in own))


def keep_least(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """docs, all columns: of the rows of each root one, that of the smallest doc_id (nulls last), then of the smallest hash.

    `rooted` has (doc_id, row, root) for each row of docs, row being row_hash. Of rows that agree in all columns one stays.
    """
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    least = least.select(F.coalesce("k.doc_id", F.lit(0)).alias("stay_id"), F.col("k.row").alias("stay_row"))
    own, row = free_names([*docs.columns, *least.columns], ["own_id", "own_row"])
    keyed = docs.withColumn(row, row_hash(docs)).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    stay = keyed.join(least.select(F.col("stay_id").alias(own), F.col("stay_row").alias(row)), [own, row], "left_semi")
    return stay.dropDuplicates([own, row]).select(*map(named, docs.columns))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts that hold little more than `most` bytes of text each, without copying."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    size = np.full(batch.num_rows, batch.num_columns * 8, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // most
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """fn over the slices of each Arrow batch; a slice without rows gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if part.num_rows and (out := fn(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
