import random

from pyspark.sql import functions as F

from helpers import pairs_frame
from tastegrid.operators import features, itemcf, ranking, skew


def rows_by_task(frame):
    counts = [row["count"] for row in frame.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return sorted(counts)


def test_join_equals_the_plain_one_and_spreads_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(400)) for k in range(6000)] + [(k, 7) for k in range(9000)] + [(1, None), (2, 100_000)]
    left = spark.createDataFrame(rows, "a int, key int").repartition(4)
    right = spark.createDataFrame([(key, key * 10 + k) for key in range(500) for k in range(2)], "key int, b int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = skew.join_hot(left, right, "key")
        plain = left.join(right, "key")
        assert sorted(found.select("a", "key", "b").collect()) == sorted(plain.select("a", "key", "b").collect())
        tasks, before = rows_by_task(found), rows_by_task(plain)
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2] < before[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_small_and_empty_sides(spark):
    left = spark.createDataFrame([(1, 5)], "a int, key int")
    right = spark.createDataFrame([(5, 2)], "key int, b int")
    assert [tuple(row) for row in skew.join_hot(left, right, "key").select("a", "key", "b").collect()] == [(1, 5, 2)]
    assert skew.join_hot(left.limit(0), right, "key").count() == 0


def test_an_item_in_every_history(spark, monkeypatch):
    """Scores and pooled vectors do not change when hot items go their own way."""
    rng = random.Random(9)
    pairs = sorted({(user, 0) for user in range(60)} | {(user, rng.randrange(1, 30)) for user in range(60) for _ in range(6)})
    seen = pairs_frame(spark, pairs)
    near = spark.createDataFrame(
        [(i, j, 1.0 / (1 + abs(i - j)), j + 1) for i in range(30) for j in range(30) if i != j],
        "item_id bigint, neighbor_id bigint, similarity double, place bigint",
    )
    histories = seen.groupBy("user_id").agg(F.sort_array(F.collect_list("item_id")).alias("history"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "item_id bigint, vector array<double>")

    def found():
        scores = itemcf.neighbor_scores(seen, near).collect()
        pooled = features.pool_history(histories, vectors, 2).collect()
        return [{(r["user_id"], r["item_id"]): round(r["score"], 9) for r in scores}, {r["user_id"]: r["pooled"] for r in pooled}]

    whole = found()
    monkeypatch.setattr(skew, "SHARE", 8)
    assert found() == whole
    known, want = set(pairs), {}
    for user, item in pairs:
        for j in range(30):
            if j != item and (user, j) not in known:
                want[user, j] = want.get((user, j), 0.0) + 1.0 / (1 + abs(item - j))
    assert whole[0] == {pair: round(score, 9) for pair, score in want.items()}


def test_rows_are_limited_before_the_shuffle_at_any_k(spark):
    scores = spark.range(40_000).select(
        (F.col("id") % 2).alias("user_id"), F.col("id").alias("item_id"),
        F.xxhash64("id").cast("double").alias("score"), F.col("id").alias("place"),
    )
    found = ranking.top_k(scores, 2000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :] and found.count() == 4000
