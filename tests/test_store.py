import gc
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagequarry.plans import graph, registry, store


CODE = """
from pyspark.sql import SparkSession
from pagequarry.plans.store import shared_folder, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
first = shared_folder(spark)
assert first == shared_folder(spark) and stored(spark.range(3), "x").count() == 3
spark.sparkContext.setCheckpointDir("{top}")
assert "{top}" in shared_folder(spark)
"""


def collected(spark):
    gc.collect()
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()


def test_folder(spark):
    assert store.shared_folder(spark).endswith("checkpoints")


def test_written_tables_go_when_nothing_reads_them(spark):
    """A table stays as long as a DataFrame that reads it, also through another DataFrame, and goes then."""
    df = store.stored(spark.range(10), "kept")
    path = next(p for p in store._alive if "/kept-" in p)
    derived = df.where("id > 3").select((F.col("id") * 2).alias("x"))
    del df
    collected(spark)
    store.stored(spark.range(1), "other")
    assert os.path.isdir(path) and derived.count() == 6
    del derived
    for _ in range(40):  # the JVM learns of it through the gateway, sooner or later
        collected(spark)
        time.sleep(0.1)
        store.stored(spark.range(1), "other")
        if not os.path.isdir(path):
            break
    assert not os.path.isdir(path)


def test_buckets_need_no_shuffle_and_leave_no_entry(spark):
    df = store.bucketed(spark.range(1000).withColumn("k", F.col("id") % 7), "dealt", ["k"], 8)
    plan = df.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.groupBy("k").count().count() == 7
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pq_")]


def test_changed_sources_are_read_again(spark, tmp_path):
    """Written relations belong to the files they came from; a folder that was emptied is filled again."""
    def orders(rows):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")

    query = registry.queries()["p17_body_zone"]
    spark.createDataFrame([(1, 1, 1, 1, 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders([(1, 5)])
    assert query(spark, str(tmp_path)).count() == 1
    orders([(1, 5), (2, 5), (3, 6)])
    assert query(spark, str(tmp_path)).count() == 3
    for path in [p for p in store._alive if "/doc_pages-" in p]:
        store.delete(spark, path)
    assert query(spark, str(tmp_path)).count() == 3
    graph.forget()


@pytest.mark.parametrize("name", ["p17_body_zone", "a9_count_tags"])
def test_queries_leave_no_views(spark, name):
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pq_")]


def test_folder_where_none_is_set(tmp_path):
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent), "TMPDIR": str(tmp_path), "SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", CODE.replace("{top}", str(tmp_path / "own"))], cwd=tmp_path, env=env, check=True)


def test_buckets_grow_with_the_sources(spark):
    assert graph.buckets(spark, [1 << 20]) == graph.LEAST_BUCKETS
    assert graph.buckets(spark, [40 * graph.BUCKET_BYTES, 1]) == 41
    assert graph.buckets(spark, [1 << 60]) == graph.MOST_BUCKETS
    assert graph.buckets(spark, []) == max(graph.LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
