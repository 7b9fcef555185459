import time

from pyspark.sql import functions as F

from helpers import toy_splits
from tastegrid.operators import pairs
from tastegrid.session import materialize


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {name for name in found if name.startswith("shuffle_")}


def test_a_written_table_counts_by_its_rows(spark):
    """Lists of one user after another take under a byte a row in a file; as such they were broadcast whole."""
    pairs.training(toy_splits(spark).train)
    n_users, k = 4000, 20
    lists = spark.range(n_users, numPartitions=1).select(
        F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    )
    table = materialize(lists.withColumn("item_id", F.col("rank").cast("bigint")))
    truth = spark.range(20 * n_users * k).select(F.col("id").alias("user_id"), F.lit(1).alias("found"))
    rows = n_users * k * 20
    estimate = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert estimate >= rows
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(rows // 2))
    try:
        plan = table.join(truth, "user_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def test_shuffles_of_a_written_table_are_dropped(spark):
    before = shuffle_files(spark)
    table = materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("key")).count())
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 700
