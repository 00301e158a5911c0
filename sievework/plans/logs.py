"""Queries over logs and streams: the driver's tables arrive in files, are read as streams in two runs, and end in commit logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.plans.registry import query
from sievework.session import table
from sievework.sources.commits import CommitLog
from sievework.sources.shared import scratch
from sievework.streaming import logs, verify

#: A row that moves the watermark past whatever waits; its own unit has no answer.
END = "~end"


def _attempts(spark, sf) -> DataFrame:
    """Turns of conversations as attempts, half an hour apart; every fifth conversation pauses for three hours."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    pause = F.when((F.col("conv_id") % 5 == 0) & (turn >= 2), 180).otherwise(0)
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(turn * 30 + pause).cast("int"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("unit"), turn.cast("int").alias("number"), at.alias("at"), F.when(F.length(text) % 4 != 0, F.length(text) % 4 == 1).alias("verified"),
        ((F.col("role") == "assistant") | (F.length(text) % 3 == 0)).alias("servable"), F.col("role").alias("pick"), F.substring(text, 1, 20).alias("text"), F.concat(F.lit("fallback "), "conv_id").alias("fallback"),
    )


@query("""WITH a AS (SELECT conv_id::VARCHAR AS unit, turn, turn * 30 + CASE WHEN conv_id % 5 = 0 AND turn >= 2 THEN 180 ELSE 0 END AS mins, length(coalesce(text, '')) % 4 = 1 AS ok, role = 'assistant' OR length(coalesce(text, '')) % 3 = 0 AS servable, role, substr(coalesce(text, ''), 1, 20) AS text FROM conversations),
  g AS (SELECT *, row_number() OVER w AS place, coalesce(mins - lag(mins) OVER w > 60, false) AS late FROM a WINDOW w AS (PARTITION BY unit ORDER BY turn)),
  k AS (SELECT * FROM (SELECT *, bool_or(late) OVER (PARTITION BY unit ORDER BY turn) AS gone FROM g) WHERE NOT gone AND place <= 4),
  u AS (SELECT unit, min(place) FILTER (WHERE ok) AS hit, max(place) AS most FROM k GROUP BY unit),
  r AS (SELECT u.*, h.servable AS served, h.text, h.role, CASE WHEN f.servable THEN f.role END AS first_pick FROM u LEFT JOIN k h ON h.unit = u.unit AND h.place = u.hit JOIN k f ON f.unit = u.unit AND f.place = 1)
  SELECT unit, CASE WHEN served THEN text ELSE 'fallback ' || unit END AS text, CASE WHEN served THEN role ELSE first_pick END AS pick, coalesce(hit, most)::INT AS attempts, NOT coalesce(served, false) AS fell_back FROM r""")
def verified_stream_answers(spark, sf) -> DataFrame:
    """One answer for each conversation, by a stateful stream that is stopped after half of its files and started again."""
    attempts, path, log, checkpoint = _attempts(spark, sf), scratch(spark), scratch(spark), scratch(spark)
    stream = lambda: verify.first_verified(verify.attempts_of(spark, path), 4, dt.timedelta(hours=1), "1 day")
    stores = min(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = attempts.agg(F.max("number")).first()[0] or 0
    for i in range(last // 3 + 1):
        attempts.where(F.floor(F.col("number") / 3) == i).coalesce(1).write.mode("append").json(path)
        if i == 0:
            verify.run_to_end(stream(), log, checkpoint, "answers", stores)
    for day in (40, 80):
        spark.createDataFrame([(END, day, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), False, False, None, None, None)], verify.ATTEMPT).coalesce(1).write.mode("append").json(path)
    verify.run_to_end(stream(), log, checkpoint, "answers", stores)
    return CommitLog(spark, log).read(verify.ANSWER).where(F.col("unit") != END).drop("due")


@query("""SELECT 'customer' AS kind, count(*) AS n, 1::BIGINT AS version FROM customer UNION ALL SELECT 'supplier', count(*), 3 FROM supplier UNION ALL SELECT 'nation', count(*), 3 FROM nation""")
def versioned_log(spark, sf) -> DataFrame:
    """A first version, one that replaces it, and one that is appended, twice asked for and after a writer that died before
    its commit; every version can still be read."""
    log = CommitLog(spark, scratch(spark))
    rows = {n: table(spark, sf, n).select(F.lit(n).alias("kind"), F.col(k).cast("long").alias("k")) for n, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))}
    log.replace(rows["customer"])
    log.replace(rows["supplier"])
    log.write_data(rows["customer"])
    for _ in range(2):
        log.append(rows["nation"], ("nations", 1))
    kinds = "kind string, k long"
    both = log.read(kinds, 1).withColumn("version", F.lit(1).cast("long")).unionByName(log.read(kinds).withColumn("version", F.lit(log.version().number).cast("long")))
    return both.groupBy("kind", "version").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, min(o_orderkey) AS any_ FROM orders GROUP BY 1) SELECT o_custkey, coalesce(urgent, any_) AS o_orderkey FROM f""")
def log_appended_once(spark, sf) -> DataFrame:
    """Urgent orders first, then all: each customer's first order that the log didn't have; a batch asked for again adds none."""
    log, kinds = CommitLog(spark, scratch(spark)), "o_custkey long, o_orderkey long"
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")
    for i, rows in enumerate((orders.where("o_orderpriority = '1-URGENT'"), orders, orders)):
        log.append_once(rows.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], kinds, ("orders", min(i, 1)))
    return log.read(kinds)


def _in_files(rows: DataFrame, by: Column, many: int, path: str, between=None) -> None:
    """Writes rows to `many` files one after another; `between` runs after the first half."""
    for i in range(many):
        rows.where(by == i).coalesce(1).write.mode("append").json(path)
        if between and i == many // 2 - 1:
            between()


@query("""SELECT lang, source, min(doc_id) AS doc_id FROM documents WHERE n_chars >= 500 GROUP BY ALL""")
def stream_appended_once(spark, sf) -> DataFrame:
    """Documents arrive in four files; the first long one of each language and source is appended, over a restart."""
    path, log, checkpoint, kinds = scratch(spark), scratch(spark), scratch(spark), "doc_id long, lang string, source string, n_chars long"
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    quarter = F.least(F.floor(F.col("doc_id") * 4 / F.lit((docs.agg(F.max("doc_id")).first()[0] or 0) + 1)), F.lit(3))

    def run() -> None:
        logs.append_unseen(logs.json_stream(spark, path, kinds).where("n_chars >= 500"), log, ["lang", "source"], ["doc_id"], kinds, checkpoint, "documents")

    _in_files(docs, quarter, 4, path, run)
    run()
    return CommitLog(spark, log).read(kinds).select("lang", "source", "doc_id")


@query("""SELECT c.c_custkey AS unit, t.n_regionkey AS kind FROM customer c, (SELECT DISTINCT n_regionkey FROM nation) t WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 5 = t.n_regionkey)""")
def pending_after_streamed_log(spark, sf) -> DataFrame:
    """Units of customer and kind that the log of orders, read as a stream in two runs, does not hold yet."""
    path, log, checkpoint, kinds = scratch(spark), scratch(spark), scratch(spark), "unit long, kind long"
    done = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("unit"), (F.col("o_orderkey") % 5).cast("long").alias("kind"))

    def run() -> None:
        logs.append_unseen(logs.json_stream(spark, path, kinds), log, ["unit", "kind"], ["unit"], kinds, checkpoint, "units")

    _in_files(done, F.col("unit") % 2, 2, path, run)
    run()
    units = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("unit"))
    kinds_ = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("kind")).distinct()
    return logs.pending_units(units, kinds_, CommitLog(spark, log).read(kinds))
