"""Caption files: the best file of each video, cleaned and flowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import untagged

#: Headers that are not text, and languages in order of preference.
HEADERS = ("WEBVTT", "Kind:", "Language:", "NOTE", "STYLE", "REGION")


def language_priority(name: Column) -> Column:
    code = F.lower(name)
    return F.when(code.contains("orig"), 9).when(code == "en", 0).when(code == "en-en", 1).when(code.isin("en-us", "en-gb"), 2).when(F.startswith(code, F.lit("en")), 5).otherwise(20)


def caption_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines that are text, cleaned: no headers, cue timings, numbers or blanks."""
    raw = F.trim(F.col(text))
    header = F.lit(False)
    for h in HEADERS:
        header = header | F.startswith(raw, F.lit(h))
    kept = lines.where(~header & (raw != "") & ~raw.contains("-->") & ~raw.rlike(r"^\d+$"))
    return kept.withColumn(text, untagged(F.col(text))).where(F.col(text) != "")


def collapse_adjacent(rows: DataFrame, group: str, order: list[str], line: str) -> DataFrame:
    """(group, joined): lines that equal the one before them go, the rest is joined by spaces in order."""
    before = F.lag(line).over(Window.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(line)))
    gathered = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("_all"))
    return gathered.select(group, F.array_join(F.transform("_all", lambda x: x[line]), " ").alias("joined"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, joined) from files named <video_id>.<language>.vtt; of several files the preferred language's is taken."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)\.([^./]+)\.vtt$", 1)
    files = files.select(name.alias("video_id"), F.regexp_extract("file", r"([^/]+)\.([^./]+)\.vtt$", 2).alias("language"), "file", "value")
    best = files.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy(language_priority(F.col("language")), "file"))).where("_n = 1")
    lines = best.select("video_id", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return collapse_adjacent(caption_lines(lines), "video_id", ["pos"], "line")
