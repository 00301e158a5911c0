"""Stand-ins for the domain's records on the driver's tables, as DataFrames and as DuckDB CTEs with the same rows.

pool: candidates of a group, best first by cp: (gid, idx, cp, p_b, p_i, p_a, agree, loss). An order is a group, its lines
are the candidates. fact: scored outputs: (item, level, model, sound, fit, fabricated, grade). A line is one output, its
supplier the model, its return flag the level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import table

#: Lines that a task of a grouping by orders gets, about; so its memory does not grow with the table.
LINES = 500_000
LEVEL_OF_FLAG = {"A": "beginner", "N": "intermediate", "R": "advanced"}


def by_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lines dealt by their order: nearly every group has one line, so combining before the shuffle would save nothing, and
    all later groupings that hold the order find it dealt. Of large tables there are as many parts as keep each bounded,
    whatever the session's shuffle partitions; the count comes from the files' footers."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    many = -(-lines.count() // LINES)
    return lines.repartition(many, "l_orderkey") if many > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines.repartition("l_orderkey")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    lines = by_order(spark, sf).groupBy(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").cast("long").alias("idx")).agg(
        F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("p_b"), F.max("l_tax").alias("p_i"), F.max("l_quantity").alias("qty")
    )
    return lines.select("gid", "idx", (F.floor("price") % 600).alias("cp"), "p_b", "p_i", (F.col("p_b") + F.col("p_i")).alias("p_a"), (F.floor("qty") % 3 != 0).alias("agree"))


POOL = """pool AS (SELECT gid, idx, CAST(floor(price) AS BIGINT) % 600 AS cp, p_b, p_i, p_b + p_i AS p_a, CAST(floor(qty) AS BIGINT) % 3 <> 0 AS agree
  FROM (SELECT l_orderkey AS gid, CAST(l_linenumber AS BIGINT) AS idx, max(l_extendedprice) AS price, max(l_discount) AS p_b, max(l_tax) AS p_i, max(l_quantity) AS qty
        FROM lineitem GROUP BY ALL))"""


def fact(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.create_map(*[F.lit(x) for kv in LEVEL_OF_FLAG.items() for x in kv])
    rows = by_order(spark, sf).groupBy(F.col("l_orderkey").alias("item"), F.element_at(flag, F.col("l_returnflag")).alias("level"), (F.col("l_suppkey") % 12).alias("model")).agg(
        F.max("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"), F.max("l_extendedprice").alias("price")
    )
    q = F.floor("qty")
    return rows.select("item", "level", "model", (q % 5 != 0).alias("sound"), (q % 2 == 0).alias("fit"), (q % 7 == 0).alias("fabricated"), F.when(q % 11 == 0, None).otherwise(F.floor(F.round(F.col("disc") * 100))).alias("grade"),
                       F.floor("price").alias("tokens"), (F.floor("price") % 8).alias("pick"), (F.floor(F.round(F.col("tax") * 100)) % 4).alias("best"))


FACT = """fact AS (SELECT item, level, model, q % 5 <> 0 AS sound, q % 2 = 0 AS fit, q % 7 = 0 AS fabricated, CASE WHEN q % 11 = 0 THEN NULL ELSE CAST(floor(round(disc * 100)) AS BIGINT) END AS grade,
    CAST(floor(price) AS BIGINT) AS tokens, CAST(floor(price) AS BIGINT) % 8 AS pick, CAST(floor(round(tax * 100)) AS BIGINT) % 4 AS best
  FROM (SELECT l_orderkey AS item, CASE l_returnflag WHEN 'A' THEN 'beginner' WHEN 'N' THEN 'intermediate' WHEN 'R' THEN 'advanced' END AS level, l_suppkey % 12 AS model,
          CAST(floor(max(l_quantity)) AS BIGINT) AS q, max(l_discount) AS disc, max(l_tax) AS tax, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL))"""
