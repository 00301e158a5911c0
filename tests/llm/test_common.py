import bisect
import random
import time

from pyspark.sql import functions as F

from sievework.llm import common
from sievework.llm.common import FREES, materialize, sorted_run


def test_find_edge_counts_edges_at_or_below(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 64, 65):
        edges = sorted(rng.sample(range(-500, 500), n))
        values = edges + [x + 1 for x in edges] + [-1000, 1000, 0]
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", common.find_edge(edges, F.col("v")).alias("n")).collect()
        assert all(r.n == bisect.bisect_right(edges, r.v) for r in got)


def test_hash_sample_is_exact_and_fixed(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"))
    one = sorted(r.k for r in common.hash_sample(rows, "k", 500).collect())
    two = sorted(r.k for r in common.hash_sample(rows.repartition(13), "k", 500).collect())
    order = rows.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), "k").limit(500)
    assert one == two == sorted(r.k for r in order.collect()) and common.hash_sample(rows.limit(3), "k", 500).count() == 3


def test_lower_case_of_a_to_z_alone(spark):
    texts = ["ABCxyz", "ÀÉ ÅBC", "", "İI"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.ascii_lower(F.col("t"))).collect()]
    assert got == ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]


def test_materialized_tables_can_be_dropped(spark):
    kept = common.materialize(spark.range(5), "five")
    assert kept.count() == 5
    common.drop(kept)
    assert not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._sievework_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._sievework_path))


def test_slices_hold_bounded_bytes_and_all_rows():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 10, 900, 5000]) for _ in range(500)] + [None, "y" * 50_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(502)), pa.array(texts)], ["i", "t"])
    parts = list(common.slices(batch, 10_000))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict() and len(parts) > 50
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 15_000 or p.num_rows == 1 or "y" * 50_000 in p.column(1).to_pylist() for p in parts)
    assert common.free_names(["a", "_a", "B"], ["a", "b", "c"]) == ["__a", "_b", "c"]


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """A stage of many written tables otherwise holds the shuffles of all of them until the driver collects its garbage."""
    before, setting = _shuffle_files(spark), spark.conf.get(FREES, None)
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 97).alias("k"))
    counted = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last")), "freed")
    joined = sorted_run(rows.repartition(5, "id").join(counted.hint("merge"), "k"), "freed", ["k"])
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert _shuffle_files(spark) - before == set()
    assert counted.count() == 97 and joined.count() == 20_000 and spark.conf.get(FREES, None) == setting


def test_inside_unbroadcast_no_join_is_gathered_in_the_driver(spark):
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small, rows = materialize(spark.range(7).withColumnRenamed("id", "k"), "small"), spark.range(100).select((F.col("id") % 9).alias("k"))
    with common.unbroadcast(spark):
        joined = rows.join(small, "k")
        assert joined.count() == 78 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == setting
    assert "BroadcastHashJoin" in rows.join(small, "k")._jdf.queryExecution().executedPlan().toString()
