"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tastegrid.operators import pairs
from tastegrid.operators.two_tower import TwoTowerRecommender
from tastegrid.plans import fixtures, queries
from tastegrid.session import materialize

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "split_summary", "ground_truth", "popularity_topk", "item_neighbors", "itemcf_topk",
    "causal_history", "categorical_codes", "numeric_features", "dot_topk", "bpr_topk",
    "evaluate_multi_k", "evaluate_user_segments", "evaluate_item_segments", "benchmark",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CORES}]")
        .config("spark.sql.shuffle.partitions", CORES)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="tastegrid-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def two_tower(spark: SparkSession, taken: dict[str, float]) -> None:
    """The reference's two timed settings: 10 epochs, batch 512, 64 dimensions."""
    log = fixtures.orders_logs(spark, FOLDER).history
    features = queries._feature_sets(spark, FOLDER)
    for name, history, sides in (
        ("two_tower_fit_id_only", False, (None, None)),
        ("two_tower_fit_feature_history", True, features),
    ):
        model = TwoTowerRecommender(use_history=history)
        taken[name] = timed(lambda: model.fit(log, "label", *sides))
        users = materialize(pairs.sample_users(model.data.seen, 5000, 2026))
        retrieval = name.replace("fit", "retrieve_5000_users")
        taken[retrieval] = timed(lambda: drain(model.recommend(users, 100)))


def main() -> None:
    spark = session()
    drain(fixtures.orders_log(spark, FOLDER))  # start-up is not timed
    taken: dict[str, float] = {}
    every = queries.all_queries()
    for name in NAMES:
        taken[name] = timed(lambda: drain(every[name](spark, FOLDER)))
    two_tower(spark, taken)
    print(
        json.dumps(
            {
                "metric": "total run time of the headline queries",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cores": int(CORES),
            }
        )
    )


if __name__ == "__main__":
    main()
