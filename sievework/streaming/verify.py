"""Verify-and-regenerate as a stateful stream: a unit's attempts arrive one by one, and one answer leaves for each unit.

A unit is served its first attempt that is verified and names a servable pick, within a budget of attempts; otherwise it
falls back to the pick of its first attempt (if that is servable) with its fallback text. A verdict that is null, as of a
verifier that failed, counts as not verified. The first verified attempt ends a unit whether its pick is servable or not:
prose for one pick is never served with another. A unit that waits longer than `patience` for its next attempt falls back
too, whether that attempt comes too late or not at all.

The state of a unit is one struct: attempts seen, the first pick, the fallback, when it is due, whether it is done. Timers
run in event time, so that a restart from the checkpoint, and any cut of the input into batches, give the same answers.
Attempts of a unit must arrive in their order; those of one batch may be in any.

Defined cases: a null unit is a unit; an attempt that was seen before (a repeated row, by its number) is ignored; what comes
after the answer is ignored; null numbers count as after all others; answers of a unit that is cut off by the end of the
input leave once the watermark passes when it is due.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream of attempts has.
ATTEMPT = "unit string, number int, at timestamp, verified boolean, servable boolean, pick string, text string, fallback string"
ANSWER = "unit string, text string, pick string, attempts int, fell_back boolean, due timestamp"
STATE = "seen int, last int, first_pick string, fallback string, due timestamp, done boolean"
#: The state store that stateful processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstVerified(StatefulProcessor):
    def __init__(self, budget: int, patience: dt.timedelta):
        self.budget, self.patience = budget, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.unit = handle, handle.getValueState("unit", STATE)

    def _fall(self, key: tuple, state: tuple) -> pd.DataFrame:
        seen, last, first_pick, fallback, due, _ = state
        self.unit.update((seen, last, first_pick, fallback, due, True))
        return self._answer(key, fallback, first_pick, seen, True, due)

    def _answer(self, key: tuple, text: str | None, pick: str | None, attempts: int, fell_back: bool, due: dt.datetime) -> pd.DataFrame:
        return pd.DataFrame({"unit": [key[0]], "text": [text], "pick": [pick], "attempts": [attempts], "fell_back": [fell_back], "due": [due]})

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["number", "at"], kind="stable")
        state = tuple(self.unit.get()) if self.unit.exists() else None
        for row in batch.itertuples(index=False):
            number = (1 << 30) if pd.isna(row.number) else int(row.number)
            if state is not None and (state[5] or number <= state[1]):
                continue
            at = row.at.to_pydatetime()
            if state is not None and at > state[4]:
                self._forget_timers()
                yield self._fall(key, state)
                return
            pick = row.pick if row.servable is True else None
            before = state or (0, 0, pick, row.fallback, None, False)
            state = (before[0] + 1, number, before[2], before[3], at + self.patience, False)
            if row.verified is True and pick is not None:
                self.unit.update((*state[:5], True))
                self._forget_timers()
                yield self._answer(key, row.text, pick, state[0], False, state[4])
                return
            if row.verified is True or state[0] >= self.budget:
                self._forget_timers()
                yield self._fall(key, state)
                return
        if state is not None and not state[5]:
            self.unit.update(state)
            self._forget_timers()
            self.handle.registerTimer(_millis(state[4]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.unit.get()) if self.unit.exists() else None
        if state is not None and not state[5]:
            yield self._fall(key, state)

    def close(self) -> None:
        pass


def _millis(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp() * 1000)


def first_verified(attempts: DataFrame, budget: int, patience: dt.timedelta = dt.timedelta(hours=1), late: str = "0 seconds") -> DataFrame:
    """One answer (ANSWER) for each unit of a stream of attempts (ATTEMPT)."""
    stream = attempts.withWatermark("at", late)
    return stream.groupBy("unit").transformWithStateInPandas(FirstVerified(budget, patience), outputStructType=ANSWER, outputMode="append", timeMode="eventTime")


def run_to_end(answers: DataFrame, log_path: str, checkpoint: str, writer: str, partitions: int | None = None) -> None:
    """Runs a stream until what is there is read; each batch is appended to the commit log once, also after a restart.

    `partitions` is in how many stores the state is kept, the session's shuffle partitions unless given; a checkpoint holds
    it fixed, so it should fit the number of units, not of a day's attempts.
    """
    from sievework.sources.commits import CommitLog

    def keep(batch: DataFrame, number: int) -> None:
        CommitLog(batch.sparkSession, log_path).append(batch, (writer, number))

    conf = answers.sparkSession.conf
    settings = STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        query = answers.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def attempts_of(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """The stream of attempts in a folder of JSON lines, in the order of the files' times."""
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", files_at_once).json(path)


def answers_by_rule(attempts: DataFrame, budget: int, patience: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """The same answers of a whole table of attempts, by windows: what the stream gives once all its units are due."""
    from pyspark.sql.window import Window

    once = attempts.groupBy("unit", "number").agg(F.min(F.struct("at", *[c for c in attempts.columns if c not in ("unit", "number", "at")])).alias("r")).select("unit", "number", "r.*")
    order = Window.partitionBy("unit").orderBy(F.col("number").asc_nulls_last())
    due = F.lag("at").over(order) + F.expr(f"interval {int(patience.total_seconds())} seconds")
    rows = once.withColumn("place", F.row_number().over(order)).withColumn("late", F.coalesce(F.col("at") > due, F.lit(False)))
    rows = rows.withColumn("late", F.max("late").over(order)).where(~F.col("late") & (F.col("place") <= budget))
    rows = rows.withColumn("ok", F.coalesce("verified", F.lit(False)))
    servable = F.coalesce("servable", F.lit(False)) & F.col("pick").isNotNull()
    first = rows.groupBy("unit").agg(
        F.min(F.when(F.col("ok"), F.col("place"))).alias("hit"), F.max("place").alias("most"), F.min_by(F.when(servable, F.col("pick")), "place").alias("first_pick"), F.min_by("fallback", "place").alias("fallback"),
        F.min_by(F.when(servable, F.struct("pick", "text")), F.when(F.col("ok"), F.col("place"))).alias("served"),
    )
    good = F.col("served").isNotNull()
    return first.select("unit", F.when(good, F.col("served.text")).otherwise(F.col("fallback")).alias("text"), F.when(good, F.col("served.pick")).otherwise(F.col("first_pick")).alias("pick"), F.coalesce("hit", "most").alias("attempts"), (~good).alias("fell_back"))
