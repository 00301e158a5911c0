"""A file-backed stand-in for the NDJSON HTTP source, with its budget and retries, and the crawl over it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sievework.sources.shared import written

MAX_WAIT = 90.0


def with_retries(fetch: Callable[[], tuple[int, float, list[str]]], retries: int, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Lines of the first answer that is not 429; waits as told, at most MAX_WAIT seconds, so many times."""
    for left in range(retries, -1, -1):
        status, wait, lines = fetch()
        if status != 429:
            return lines
        if left:
            sleep(min(wait, MAX_WAIT))
    return []


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        paths = [p for p in self.options.get("paths", "").split(",") if p]
        return [InputPartition(p) for p in paths[: int(self.options.get("budget", len(paths)))]]

    def _request(self, path: str, asked: list[int]) -> tuple[int, float, list[str]]:
        """(status, seconds to wait, lines): a path that `refuse` names answers 429 so many times."""
        refuse = dict(x.rsplit(":", 1) for x in self.options.get("refuse", "").split(",") if x)
        asked.append(1)
        if len(asked) <= int(refuse.get(path, 0)):
            return 429, float(self.options.get("wait", 0)), []
        with open(path, encoding="utf-8") as lines:
            return 200, 0.0, list(lines)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        asked: list[int] = []
        for line in with_retries(lambda: self._request(partition.value, asked), int(self.options.get("retries", 3))):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            yield tuple(row.get(f.name) for f in self.schema.fields)


class NdjsonSource(DataSource):
    """spark.read.format("ndjson_stub").schema(...).option("paths", "a,b").option("budget", 2): a request is a file.

    Refused requests (option refuse, "path:times,...") are made again, at most `retries` times, after the wait they ask for.
    """

    @classmethod
    def name(cls) -> str:
        return "ndjson_stub"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NdjsonSource)


def crawl(games: DataFrame, seeds: DataFrame, rounds: int, per_round: int) -> DataFrame:
    """(player, depth): breadth first over who played whom, at most per_round new players each round, by name.

    games has (white, black); seeds has (player). Visited players are left out by an anti join.
    """
    pairs = games.select(F.col("white").alias("p"), F.col("black").alias("q")).union(games.select("black", "white")).distinct()
    seen = seeds.select("player").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for depth in range(1, rounds + 1):
        near = edge.join(pairs, edge.player == pairs.p).select(F.col("q").alias("player")).distinct().join(seen, "player", "left_anti")
        edge = near.orderBy("player").limit(per_round).withColumn("depth", F.lit(depth))
        seen = seen.unionByName(edge)
    return seen


def crawl_to_targets(extracts: DataFrame, meets: DataFrame, seeds: DataFrame, targets: dict[str, int], budget: int, per_round: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """(rows taken, how many of each level): players are asked in rounds, of the level that is furthest below its target.

    extracts has (player, level, id), meets (player, other, other_level), seeds (player, level). A round asks the next
    `per_round` unasked players of the queue of that level, by name (another level's if it is empty); their new ids are
    taken up to the targets, and whom they met joins the queues. It ends when the targets or the budget of players are
    reached, or no one is left to ask. Ids count once. What the driver keeps is a number for each level.
    """
    counts, asked = dict.fromkeys(targets, 0), 0
    queue = seeds.select("player", "level").distinct()
    done = seeds.select("player").limit(0)
    taken = extracts.limit(0)
    while asked < budget and any(counts[x] < n for x, n in targets.items()):
        waiting = queue.join(done, "player", "left_anti").groupBy("player").agg(F.min("level").alias("level"))
        short = sorted(targets, key=lambda x: (counts[x] - targets[x], list(targets).index(x)))
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, level in enumerate(short) for x in (level, i)]), F.col("level")), F.lit(len(short)))
        ask = spark_rows(waiting.orderBy(rank, "player").limit(min(per_round, budget - asked)).select("player"))
        n = ask.count()
        if not n:
            break
        asked += n
        done = done.unionByName(ask)
        new = extracts.join(ask, "player", "left_semi").join(taken.select("id"), "id", "left_anti").dropDuplicates(["id"])
        most = F.element_at(F.create_map(*[F.lit(x) for level, n in targets.items() for x in (level, n - counts[level])]), F.col("level"))
        place = F.row_number().over(Window.partitionBy("level").orderBy("player", "id"))
        new = spark_rows(new.withColumn("_p", place).where(F.col("_p") <= most).select(*extracts.columns))
        for r in new.groupBy("level").agg(F.count("*").alias("n")).collect():
            counts[r.level] += r.n
        taken = taken.unionByName(new)
        queue = queue.unionByName(meets.join(ask, "player", "left_semi").select(F.col("other").alias("player"), F.col("other_level").alias("level")))
    return taken, counts


def spark_rows(small: DataFrame) -> DataFrame:
    """A round's rows as a table of their own in the shared folder, so that plans do not grow and nothing passes the driver."""
    return written(small, "crawl")


def fixed_ids(extracts: DataFrame, ids: list[str], count: int, levels: tuple[str, ...]) -> DataFrame:
    """Without a crawl: the rows of a fixed list of sources, each level up to the whole count; of an id that several sources
    have, the row of the source that is listed first stays."""
    from sievework.sources.banks import up_to_targets

    listed = F.array(*map(F.lit, dict.fromkeys(ids)))
    rows = extracts.where(F.col("source").isin(list(dict.fromkeys(ids))))
    rows = rows.groupBy("id").agg(F.min_by(F.struct(*extracts.columns), F.struct(F.array_position(listed, F.col("source")).alias("p"), "level")).alias("one")).select("one.*")
    return up_to_targets(rows, "level", "id", {x: count for x in levels})
