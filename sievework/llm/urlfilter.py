"""URL filters as a sort-merge range join of canonical keys against nested prefix rules.

The canonical key of a host is its labels in reverse, each closed by U+0001; that of a rule is its host's key, U+0000 and
its path. All paths that a rule fits on its own host are one interval of keys, and any two rules' intervals nest or are
disjoint. A page is a point on its own host and on each host around it (as many points as it has labels, and one), so
rules are never copied to the hosts below them. Points and rules are dealt by ranges of the key (points also by a hash, so
that a host with a third of all pages is split), sorted, and swept once. Each rule's row brings the stack of the rules that
are open where it begins, itself on top; the sweep hands the last one on, and a point takes the topmost rule that its path
starts with. A range begins with the stack that the ranges before it leave open. A page then takes the longest of its
points' rules. Stacks are as deep as rules of one host nest; they come from joining the rules to the prefixes of their own
paths. Everything is DataFrame functions; the sweep is a window.

Defined cases: a null url, or one without "://", has an empty host and an empty path and fits no rule with a host;
repeated pages are judged each on their own; null page_ids are kept; an empty table gives an empty result; other columns
of pages are ignored. A rule with an empty host fits every page whose path starts with the rule's. Rules are
(rule_no, host, path, verdict); of equal (host, path) rules the first in order holds, and so for rules of equal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sievework.llm.common import MOST_SAMPLED, ascii_lower, find_edge, hash_sample, parts

#: The contract's rules.
BASE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: What the method says of a page that no rule fits.
DEFAULT_VERDICT = "allow"
#: Ranges for each shuffle partition, and pages sampled for each range; both only steer the dealing, never the result.
RANGES_PER_PARTITION, SAMPLED_PER_RANGE = 4, 32


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by U+0001; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001")))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = BASE_RULES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_no long, host string, path string, verdict string").coalesce(1)


RULE = "struct<size:int,order:bigint,key:string,path:string,rule:string,verdict:string>"


def around(key: Column) -> Column:
    """The keys of a host and of all hosts around it, the empty one first."""
    labels = F.split(key, "\u0001")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(labels, 1, n), "\u0001"), F.lit("\u0001")))))


def _stacks(rules: DataFrame) -> DataFrame:
    """(place, stack): for each (host, path) that has a rule, this rule and those of the same host that it lies in."""
    one = F.struct(F.length(F.concat("host", "path")).alias("size"), (-F.col("rule_no")).alias("order"), "key", "path", F.concat("host", "path").alias("rule"), "verdict").cast(RULE)
    named = rules.withColumn("key", host_key(F.col("host"))).select("key", "path", one.alias("one")).groupBy("key", "path").agg(F.max("one").alias("one"))
    heads = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    within = named.select("key", F.col("path").alias("inner"), F.explode(heads).alias("path")).join(named, ["key", "path"])
    return within.groupBy("key", "inner").agg(F.collect_list("one").alias("stack")).select(F.concat("key", F.lit("\u0000"), "inner").alias("place"), "stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row for each row of pages; `rules` has (rule_no, host, path, verdict)."""
    spark = pages.sparkSession
    seen = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tail = F.concat("path", F.lit("\u0001"), F.hex(F.xxhash64("page_id", "host", "path", "row")))
    points = seen.withColumn("outer", F.explode(around(host_key(F.col("host"))))).withColumn("place", F.concat("outer", F.lit("\u0000"), tail))
    ranges = RANGES_PER_PARTITION * parts(spark)
    # A bounded sample of places gives the edges of the ranges, as in any range partitioning.
    places = sorted(r.place for r in hash_sample(points.select("place"), "place", min(MOST_SAMPLED, ranges * SAMPLED_PER_RANGE)).collect())
    edges = sorted({places[i * len(places) // ranges] for i in range(1, ranges)}) if places else []
    page = StructType([StructField("row", LongType()), *(pages.schema["page_id"],), StructField("host", StringType()), StructField("path", StringType())])
    no_page = [F.lit(None).cast(f.dataType).alias(f.name) for f in page.fields]
    stacks = _stacks(rules).withColumn("range", find_edge(edges, F.col("place")))
    # What is open where a range begins: the last rule of the ranges before it, found among as many keys as there are ranges.
    last = {r.range: r.place for r in stacks.groupBy("range").agg(F.max("place").alias("place")).collect()}
    carried, now = [], None
    for i in range(len(edges) + 1):
        if now is not None:
            carried.append((i, now))
        now = last.get(i, now)
    begins = spark.createDataFrame(carried, "at int, place string").coalesce(1)
    open_ = begins.join(stacks.drop("range"), "place").select(F.col("at").alias("range"), F.lit("").alias("place"), F.lit(-1).alias("kind"), *no_page, "stack")
    rules_in = stacks.select("range", "place", F.lit(0).alias("kind"), *no_page, "stack")
    points_in = points.select(find_edge(edges, F.col("place")).alias("range"), "place", F.lit(1).alias("kind"), "row", "page_id", "host", "path", F.lit(None).cast(f"array<{RULE}>").alias("stack"))
    sweep = Window.partitionBy("range").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points_in.unionByName(rules_in).unionByName(open_).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    # The last rule may be another host's; the place says on which host the point lies.
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]) & (r["key"] == F.substring_index("place", "\u0000", 1)))
    best = swept.withColumn("best", F.array_max(fits)).groupBy("row", "page_id", "host", "path").agg(F.max("best").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the base rules over all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules_table(spark))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row_id FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT row_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (row_id)
"""
