"""Line-delimited JSON with three error policies, documents with sidecars, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from sievework.operators.joins import first_per_key, last_per_key


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) is not None


def read_tolerant(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line; a missing file is empty; blank and broken lines go."""
    schema = _schema(schema)
    try:
        if not _there(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_keeping_bad(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Every line that is not blank: raw, parsed struct `row` (null where broken) and reason ('invalid_json' or null)."""
    schema = _schema(schema)
    wide = schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("raw"), F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    bad = F.col("j").isNull() | F.col("j._corrupt").isNotNull()
    return parsed.select("raw", F.when(~bad, F.struct(*[F.col(f"j.{c}") for c in wide.names if c != "_corrupt"])).alias("row"), F.when(bad, "invalid_json").alias("reason"))


def read_failfast(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The first broken line ends the query with an error that names the file."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A whole-file JSON document; a missing file is empty."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path) if _there(spark, path) else spark.createDataFrame([], _schema(schema))


def manifest(spark: SparkSession, path: str, schema: str | StructType, key: str = "video_id") -> DataFrame:
    """Documents that are lists, one row per key; the last duplicate wins, by the files' names and the place in them."""
    if not _there(spark, path):
        return read_document(spark, path, schema)
    rows = _with_position(spark.read.schema(_schema(schema)).option("multiLine", True).json(path))
    return last_per_key(rows, [key], "_at").drop("_at")


def _with_position(rows: DataFrame) -> DataFrame:
    """Adds _at: file, where the split starts in it, and the row in the split; so order holds however files are split."""
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("_at"))


def union_first_wins(spark: SparkSession, path: str, schema: str | StructType, key: list[str]) -> DataFrame:
    """Several files in the order of their names; the first row of each key stays."""
    return first_per_key(_with_position(spark.read.schema(_schema(schema)).json(path)), key, ["_at"]).drop("_at")


def union_last_wins(spark: SparkSession, path: str, schema: str | StructType, key: list[str]) -> DataFrame:
    """Later files and lines override earlier ones."""
    return last_per_key(_with_position(spark.read.schema(_schema(schema)).json(path)), key, "_at")


def key_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Blank-separated keys of a text file, distinct."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias(name)).where(F.col(name) != "").distinct()


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_atomic(rows: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines by a whole new one: rows are written beside it, then the folders change names.

    A failed write leaves the old rows. Between the two renames the path is missing for a moment; no reader sees a part.
    """
    spark = rows.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = to(f"{path}.new-{uuid.uuid4().hex}"), to(f"{path}.old-{uuid.uuid4().hex}")
    rows.write.json(new.toString())
    had = fs.exists(to(path)) and fs.rename(to(path), old)
    if not fs.rename(new, to(path)):
        if had:
            fs.rename(old, to(path))
        raise OSError(f"cannot rename {new} to {path}")
    if had:
        fs.delete(old, True)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to an append-only log."""
    rows.write.mode("append").json(path)


def write_manifest(rows: DataFrame, by: str, size: str, path: str) -> None:
    """One JSON document: each source's row under its key, and the total size."""
    entry = F.struct(F.col(by).alias("key"), F.struct(*rows.columns).alias("value"))
    rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources"), F.sum(size).alias("total")).coalesce(1).write.mode("overwrite").json(path)


def blind_export(rows: DataFrame, item: str, member: str, text: str, n_members: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): of items that all members answered, the answers under shuffled letters, and which letter is who."""
    from sievework.operators.joins import complete_items
    from sievework.operators.sampling import anonymised

    labelled = anonymised(complete_items(rows, item, member, n_members), item, member, seed)
    sheet = labelled.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("label", text))).alias("responses"))
    return sheet, labelled.select(item, "label", member)


def markdown_table(rows: DataFrame, order: list[str], title: str = "") -> DataFrame:
    """(report): the rows, a bounded table, as one markdown table under its title, in order; null is an empty cell."""
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in rows.columns]), " | "), F.lit(" |"))
    head = ([f"# {title}", ""] if title else []) + ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))).alias("all"))
    return listed.select(F.array_join(F.concat(F.array(*map(F.lit, head)), F.transform("all", lambda x: x["line"])), "\n").alias("report"))


def write_report(rows: DataFrame, order: list[str], title: str, path: str) -> None:
    """The markdown table as a text file in a folder."""
    markdown_table(rows, order, title).coalesce(1).write.mode("overwrite").text(path)
