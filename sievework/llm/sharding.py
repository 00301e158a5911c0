"""Balanced label propagation: documents move to their neighbours' shards under quotas, then counts are made even.

Neighbours are documents with equal texts. A group is kept as a hub: the table of (group, shard) counts says how many
neighbours a document has in each shard, so no pairs are made. Every document starts in a shard of its hash. In each
round a group's members propose to move to the shard with most of the group among those with room; proposals are tallied
by source, target, gain and a hash (a bounded table), a target admits the highest gains first up to its quota, room that
moves leave behind is used again, and a tally that only fits in part (a group larger than a shard) is admitted in part. Documents alone in their group never cut a
link, so they are left for the last step: shards above their count give them first, then group members, to those below,
and every shard gets a gapless numbering from counts of (shard, hash) cells. The law is `rows`: counts at most one apart.

Every row has a number of its own, a hash of its doc_id, its text and how many such rows stand before it, and all hashes
are of that number. So rows that share a doc_id, or have none, are dealt and admitted one by one, and the result depends on
neither the files nor the partitions that the rows come in.

Defined cases: a null text has size 1 and the checksum of no bytes, and null and empty texts are equal texts; repeated
rows are documents each; null doc_ids are placed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import drop, materialize, text_of

SHARDS, ROUNDS = 8, 6
#: Hash cells that proposals of one target and gain are tallied by, and parts in a thousand of a cell that may be admitted.
CELLS, SHARE = 32, 1000
#: Parts that a shard's rows are numbered in, one after another.
DEALS = 1024


def described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, group_id, size, text_crc32) of every row; group_id is a hash of the text, and row one of doc_id, text and
    how many such rows stand before it.

    Rows that agree in doc_id and text are told apart by a number, and it makes no difference which of them has which. They
    are counted by the input's split and the counts summed up, so that many such rows need not meet in one task.
    """
    text = text_of().cast("string")
    base = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("group_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = materialize(base.withColumn("split", F.shiftright("at", 33)), "shard-read")
    counts = base.groupBy("doc_id", "group_id", "split").agg(F.count("*").alias("n"))
    along = Window.partitionBy("doc_id", "group_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("doc_id").alias("d"), F.col("group_id").alias("g"), F.col("split").alias("p"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("doc_id", "group_id", "split").orderBy("at")) - 1
    joined = base.withColumn("local", local).join(counts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("group_id") == F.col("g")) & (F.col("split") == F.col("p")))
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), "group_id", "size", F.col("before") + F.col("local"))
    return joined.select(row.alias("row"), "doc_id", "group_id", "size", "text_crc32")


def _cell(group: Column) -> Column:
    return F.pmod(F.xxhash64(group, F.lit(7)), F.lit(CELLS)).cast("int")


def admitted(demand: list[tuple[int, int, int, int, int]], room: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(source, target, level, cell, share of SHARE): what targets with so much room admit of (source, target, level, cell, n).

    Highest gains first, fewest rows first among equals, so one large group does not shut out small ones; what leaves a
    source gives it room again, so the list is gone through until nothing more fits whole; then tallies larger than all
    room there is are admitted in part.
    """
    left, waiting, out = dict(room), sorted(demand, key=lambda x: (-x[2], x[4], x)), []
    while True:
        still = []
        for source, target, level, cell, n in waiting:
            if n <= left.get(target, 0):
                out.append((source, target, level, cell, SHARE))
                left[target] -= n
                left[source] = left.get(source, 0) + n
            else:
                still.append((source, target, level, cell, n))
        if len(still) == len(waiting):
            break
        waiting = still
    for source, target, level, cell, n in waiting:
        here = left.get(target, 0)
        share = SHARE * here * 19 // (20 * n) if here > 0 else 0
        if share:
            out.append((source, target, level, cell, share))
            left[target] -= here
    return out


def propagate(grouped: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """`grouped` (with row, group_id, shard) after the rounds; no shard is filled above quota by moves."""
    spark, now = grouped.sparkSession, grouped
    for i in range(rounds):
        tally = materialize(now.groupBy("group_id", "shard").agg(F.count("*").alias("n")), "shard-tally")
        held = {r.shard: r.n for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {s: quota - held.get(s, 0) for s in range(shards)}
        open_ = [s for s in range(shards) if i % 2 == 0 or room[s] > 0]
        if not open_:
            break
        # Equal counts are decided by a hash, not by the shard's number, so that no shard is favoured.
        first = F.struct("n", F.xxhash64("group_id", "shard").alias("h"), F.col("shard").alias("t"))
        best = tally.where(F.col("shard").isin(open_)).groupBy("group_id").agg(F.max(first).alias("best"))
        best = best.select("group_id", F.col("best.n").alias("n_there"), F.col("best.t").alias("target"))
        asked = tally.join(best, "group_id").where((F.col("shard") != F.col("target")) & (F.col("n_there") >= F.col("n")))
        asked = asked.withColumn("level", F.floor(F.log2(F.col("n_there") - F.col("n") + 1)).cast("int")).withColumn("cell", _cell(F.col("group_id")))
        asked = materialize(asked.select(F.col("group_id").alias("g"), F.col("shard").alias("s"), "target", "level", "cell", "n"), "shard-asked")
        # At most shards * shards * 64 levels * CELLS rows.
        demand = [(r.s, r.target, r.level, r.cell, r.n) for r in asked.groupBy("s", "target", "level", "cell").agg(F.sum("n").alias("n")).collect()]
        grant = admitted(demand, room)
        if not grant:
            drop(tally)
            drop(asked)
            if i % 2 == 0:
                continue
            break
        granted = spark.createDataFrame(grant, "s int, target int, level int, cell int, share int").coalesce(1)
        moves = materialize(asked.join(F.broadcast(granted), ["s", "target", "level", "cell"]).select("g", "s", "target", "share"), "shard-moves")
        moved = now.join(moves, (F.col("group_id") == F.col("g")) & (F.col("shard") == F.col("s")), "left")
        goes = F.col("target").isNotNull() & (F.pmod(F.xxhash64("row", F.lit(i)), F.lit(SHARE)) < F.col("share"))
        new = materialize(moved.select(*[c for c in now.columns if c != "shard"], F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")), "shard-state")
        for old in (tally, asked, moves, now):
            drop(old)
        now = new
    return now


def even_out(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`rows` (with row, shard, tied) with shard made even and slot: counts at most one apart, slots gapless from 0.

    Rows are ranked in each shard, those that are not tied to others first. A shard above its count gives its first ranks.
    """
    rows = rows.withColumn("prio", F.col("tied").cast("int")).withColumn("deal", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(DEALS)).cast("int"))
    counts = materialize(rows.groupBy("shard", "prio", "deal").agg(F.count("*").alias("n")), "shard-cells")
    have = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    total = sum(have.values())
    have = [have.get(s, 0) for s in range(shards)]
    want = [total // shards + (s < total % shards) for s in range(shards)]
    before = Window.partitionBy("shard").orderBy("prio", "deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("shard").alias("s"), F.col("prio").alias("p"), F.col("deal").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("shard", "prio", "deal").orderBy("row")
    ranked = rows.withColumn("place", F.row_number().over(place) - 1)
    ranked = ranked.join(bases, (F.col("shard") == F.col("s")) & (F.col("prio") == F.col("p")) & (F.col("deal") == F.col("d"))).withColumn("rank", F.col("base") + F.col("place"))
    gives = [max(0, h - w) for h, w in zip(have, want)]
    takes = [max(0, w - h) for h, w in zip(have, want)]
    table = lambda xs: F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("shard"))
    goes = F.col("rank") < table(gives)
    turn = table([sum(gives[:s]) for s in range(shards)]) + F.col("rank")
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(shards)):
        first = sum(takes[:s])
        here = (turn >= first) & (turn < first + takes[s])
        target, slot = F.when(here, F.lit(s)).otherwise(target), F.when(here, turn - first + have[s]).otherwise(slot)
    out = ranked.withColumn("to", F.when(goes, target).otherwise(F.col("shard"))).withColumn("slot", F.when(goes, slot).otherwise(F.col("rank") - table(gives)))
    return out.withColumn("shard", F.col("to")).drop("to", "prio", "deal", "place", "rank", "s", "p", "d", "base")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, doc_id, group_id, size, text_crc32, shard, tied, slot) of every row of docs."""
    base = materialize(described(docs), "shard-docs")
    # Groups of two or more; the join may be split where one group holds many of the rows.
    many = materialize(base.groupBy(F.col("group_id").alias("many_id")).agg(F.count("*").alias("n")).where("n > 1").select("many_id"), "shard-groups")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    state = materialize(base.join(many, base.group_id == many.many_id, "left").select(*base.columns, start.alias("shard"), F.col("many_id").isNotNull().alias("tied")), "shard-start")
    drop(many)
    total = state.count()
    tied = materialize(state.where("tied"), "shard-tied")
    grouped = propagate(tied, max(1, total // shards), shards, rounds)
    return even_out(state.where("not tied").unionByName(grouped), shards)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in eight shards, counts at most one apart, equal texts together where they fit."""
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
