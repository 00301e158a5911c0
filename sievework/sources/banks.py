"""Raw record banks: puzzle CSV, game text, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import rating_of_title
from sievework.functions.buckets import level_cut
from sievework.sources.shared import written

# The columns of the puzzle bank.
PUZZLE_COLUMNS = ("PuzzleId", "FEN", "Moves", "Rating", "RatingDeviation", "Popularity", "NbPlays", "Themes", "GameUrl", "OpeningTags")


def read_puzzles(spark: SparkSession, path: str) -> DataFrame:
    """Puzzle CSV with a header; rows whose Rating is no whole number go; moves and themes are lists."""
    schema = ", ".join(f"{c} string" for c in PUZZLE_COLUMNS)
    raw = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    numbers = {c: F.col(c).try_cast("int") for c in ("Rating", "RatingDeviation", "Popularity", "NbPlays")}
    rows = raw.withColumns(numbers).where(F.col("Rating").isNotNull())
    return rows.withColumn("Moves", F.split("Moves", " ")).withColumn("Themes", F.filter(F.split(F.coalesce("Themes", F.lit("")), " "), lambda t: t != ""))


#: Splits whose counts are broadcast at most (some 150 bytes each); games whose sizes are summed together.
BROADCAST_SPLITS, RUN = 100_000, 4096


def numbered(rows: DataFrame, name: str = "record_no") -> DataFrame:
    """rows (with file, start and row: the file, where the split starts in it, and a number that rises within the split by
    one a row) and their numbers in the file, from 1; start and row go.

    Rows are counted by split, the counts are summed up along each file, and each row adds its place in its split: no row is
    moved, and no task holds a file. Both readings must be split alike, which is checked.
    """
    splits = rows.groupBy(F.col("file").alias("_file"), F.col("start").alias("_start")).agg(F.count("*").alias("_n"), F.min("row").alias("_first"))
    along = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))), "splits")
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    place = F.col("row") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_base") + place + 1).otherwise(F.raise_error(F.lit("a file was split otherwise when it was read again")).cast("long"))
    joined = rows.join(splits, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    return joined.withColumn(name, number).drop("_file", "_start", "_n", "_first", "_base", "start", "row")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, white_elo, black_elo, has_eval, bytes, game_no) of the games of PGN files.

    Records are cut at "[Event " by the reader, so a file is split over tasks; numbers follow the order in the file.
    """
    raw = spark.read.option("lineSep", "[Event ").text(path).where(F.trim("value") != "")
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    text = F.concat(F.lit("[Event "), "value")
    elo = lambda side: F.regexp_extract("value", rf'\[{side}Elo "(\d+)"\]', 1).try_cast("int")
    rows = raw.select("file", "start", "row", text.alias("text"), elo("White").alias("white_elo"), elo("Black").alias("black_elo"), F.contains("value", F.lit("%eval")).alias("has_eval"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, "game_no")


def slice_games(games: DataFrame, max_games: int, max_bytes: int) -> DataFrame:
    """The first whole games of each file: as long as there are fewer than max_games, which hold less than max_bytes.

    games has file, game_no (gapless from 1) and bytes. Sizes are summed along a file by runs of RUN games first, so that
    no task holds more than a run.
    """
    games = games.where(F.col("game_no") <= max_games).withColumn("_run", F.floor((F.col("game_no") - 1) / RUN))
    runs = games.groupBy(F.col("file").alias("_file"), F.col("_run").alias("_r")).agg(F.sum("bytes").alias("_b"))
    along = Window.partitionBy("_file").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_b").over(along), F.lit(0))).where(F.col("_before") < max_bytes).drop("_b")
    inside = games.join(runs, (F.col("file") == F.col("_file")) & (F.col("_run") == F.col("_r")))
    earlier = F.coalesce(F.sum("bytes").over(Window.partitionBy("file", "_run").orderBy("game_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("_sum", F.col("_before") + earlier).where(F.col("_sum") < max_bytes).drop("_run", "_file", "_r", "_before", "_sum")


def rating_histogram(games: DataFrame, width: int = 200) -> DataFrame:
    sides = games.select(F.explode(F.array("white_elo", "black_elo")).alias("elo")).where("elo is not null")
    return sides.groupBy((F.floor(F.col("elo") / width) * width).alias("low")).agg(F.count("*").alias("n"))


def playable(games: DataFrame) -> DataFrame:
    """Rated standard games of two settled humans at a usual pace; columns as in the game API's rows."""
    return games.where((F.col("variant") == "standard") & F.col("rated") & F.col("speed").isin("blitz", "rapid") & ~F.coalesce("white_bot", F.lit(False)) & ~F.coalesce("black_bot", F.lit(False)) & ~F.coalesce("provisional", F.lit(False)))


def up_to_targets(rows: DataFrame, level: str, order: str, targets: dict[str, int]) -> DataFrame:
    """The first rows of each level up to its target; levels without one go."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col(level))
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(level).orderBy(order))).where(F.col("_p") <= most).drop("_p")


def with_levels(rows: DataFrame, hints: DataFrame, playlists: dict[str, str]) -> DataFrame:
    """rows (with playlist and video_id) and their level: the manifest's, else the title's rating, else the playlist's, else intermediate.

    hints has (video_id, title, level_hint), one row for each video. Rows are shuffled whole, so drop texts that aren't needed first.
    """
    default = F.element_at(F.create_map(*[F.lit(x) for kv in (playlists or {"": ""}).items() for x in kv]), F.col("playlist"))
    level = F.coalesce("level_hint", level_cut(rating_of_title(F.coalesce("title", F.lit("")))), default, F.lit("intermediate"))
    return rows.join(hints, "video_id", "left").select(*[rows[c] for c in rows.columns], level.alias("level"))


def read_transcripts(spark: SparkSession, path: str, hints: DataFrame, playlists: dict[str, str]) -> DataFrame:
    """(playlist, video_id, text, level) of <playlist>/<video>.txt files, with levels as in with_levels.

    A file without bytes is a transcript of no text: Spark lists such files, but does not read them. The driver holds the files'
    names and each file costs a listing and an opening; bundles (write_bundles) are for transcripts by the million.
    """
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    names = spark.createDataFrame([(name,) for name in texts.inputFiles()], "file string")
    files = names.join(texts, "file", "left")
    rows = files.select(F.regexp_extract("file", r"([^/]+)/[^/]+\.txt$", 1).alias("playlist"), F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("video_id"), F.coalesce("value", F.lit("")).alias("text"))
    return with_levels(rows, hints, playlists)


def write_bundles(rows: DataFrame, path: str) -> None:
    """Writes rows (with playlist, file and text) as bundles: each playlist's folder has a few files, in which many transcripts
    stand whole under their names (<video>.txt). Two transcripts may have the same name."""
    rows.select("playlist", "file", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("playlist").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(playlist, video_id, text) of the transcripts in bundles, found by their folder's and their own names."""
    rows = spark.read.schema("file string, text string, playlist string").parquet(path)
    return rows.select("playlist", F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("video_id"), "text")
