"""Every operator as a query over the fixture tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.columns import norm, text_code, unit
from tastegrid.operators import bpr, features, itemcf, metrics, pairs, retrieval, segments
from tastegrid.operators import splits as cuts
from tastegrid.operators.popularity import PopularityRecommender
from tastegrid.operators.ranking import first_unseen, popularity_ranking, top_k
from tastegrid.operators.two_tower import Features, TwoTowerRecommender
from tastegrid.plans import fixtures as X
from tastegrid.plans import jobs
from tastegrid.session import materialize, scratch_path
from tastegrid.sources import logs as sources
from tastegrid.sources import sinks

K = 20
KS = [5, 10, 20]
NEIGHBORS = 100
HISTORY = 20
PARTS = 4
FACTORS = 4
SEED = 2026
RUN_TIMES = ("fit_seconds", "milliseconds_per_user")
USER_COLUMNS = (("segment", "nation"), ("balance",))
ITEM_COLUMNS = (("brand", "kind"), ("size", "price"))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Shared inputs


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return X.orders_logs(spark, folder).history


def _case(spark: SparkSession, folder: str) -> jobs.Case:
    return jobs.evaluation_case(X.orders_logs(spark, folder).split(), names=("validation",))


def _popular(case: jobs.Case, split: str = "validation") -> DataFrame:
    model = PopularityRecommender().fit_training(case.data)
    return materialize(model.recommend(case.users[split], K))


def _digits(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({name: F.round(name, digits) for name in names})


def _listed(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _embeddings(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return X.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias(key), F.col("embedding").alias("vector")
    )


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    time = F.col(column)
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = F.hour(time) * 60 + F.minute(time)
    seconds = F.extract(F.lit("SECOND"), time)
    return (days * 1440 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def _timed(frame: DataFrame, *names: str) -> DataFrame:
    """Times as text, which compares alike in every engine."""
    return frame.withColumns({name: F.col(name).cast("string") for name in names})


# Sources


def _as_csv(log: DataFrame, spark: SparkSession, name: str) -> str:
    """The log written as CSV with the columns of the public dataset."""
    path = scratch_path(spark, name)
    log.select(
        "user_id",
        F.col("item_id").alias("video_id"),
        _micros("event_time").alias("time_ms"),
        F.col("label").alias("is_click"),
        F.col("tie").alias("event_id"),
    ).write.option("header", True).csv(path)
    return path


@query
def read_log(spark: SparkSession, folder: str) -> DataFrame:
    path = _as_csv(X.events_log(spark, folder), spark, "events-csv")
    log = sources.read_log(spark, path)
    event = F.col("event_id").cast("bigint").alias("event_id")
    return log.select("user_id", "item_id", "event_time", "label", event)


def _raw_logs(spark: SparkSession, folder: str) -> str:
    """The three order logs as CSV under the public dataset's names, in one folder."""
    root, logs = scratch_path(spark, "raw-logs"), X.orders_logs(spark, folder)
    names = {sources.HISTORY_FILE: logs.history, sources.FUTURE_FILE: logs.future, sources.RANDOM_FILE: logs.audit}
    for name, log in names.items():
        log.select(
            "user_id", F.col("item_id").alias("video_id"), _micros("event_time").alias("time_ms"),
            F.col("label").alias("is_click"), "tie.l_orderkey", "tie.l_linenumber", "tie.l_suppkey",
        ).write.option("header", True).csv(f"{root}/data/{name}")
    return root


@query
def load_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every row and column that the loader finds in the three files."""
    logs = sources.load_logs(spark, _raw_logs(spark, folder))
    others = [F.col(name).cast("bigint").alias(name) for name in ("l_orderkey", "l_linenumber", "l_suppkey")]
    parts = [
        log.select(F.lit(name).alias("log"), "user_id", "item_id", "event_time", "label", *others)
        for name, log in zip(("history", "future", "random_audit"), logs)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def prepare(spark: SparkSession, folder: str) -> DataFrame:
    """Splits and summary written from the raw files; the rows that are read back, by split."""
    raw, processed = _raw_logs(spark, folder), scratch_path(spark, "processed")
    jobs.prepare(spark, raw, processed)
    summary = spark.read.json(f"{processed}/summary.json")
    stacked = sources.load_prepared(spark, f"{processed}/splits").stacked()
    read = stacked.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows_read"), F.sum("label").cast("bigint").alias("positives_read")
    )
    columns = [F.col(name).cast("bigint").alias(name) for name in ("interactions", "users", "items", "start_time", "end_time")]
    rate = F.round("positive_rate", 6).alias("positive_rate")
    return summary.select("split", *columns, rate).join(read, "split")


def _unpivoted(table: DataFrame, side: str, key: str, texts: tuple, numbers: tuple) -> DataFrame:
    """Feature columns as rows of side, id, feature, value and number."""
    cells = [
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("string").alias("value"), F.lit(None).cast("double").alias("number"))
        for name in texts
    ] + [
        F.struct(F.lit(name).alias("feature"), F.lit(None).cast("string").alias("value"), F.col(name).cast("double").alias("number"))
        for name in numbers
    ]
    return table.select(F.lit(side).alias("side"), F.col(key).alias("id"), F.inline(F.array(*cells)))


@query
def load_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature column of both sides, from files that the loader looks up."""
    root = scratch_path(spark, "raw-features")
    for name, table, key, source_key in (
        (sources.USER_FEATURE_FILE, X.customer_features(spark, folder), "user_id", "user_id"),
        (sources.ITEM_FEATURE_FILE, X.part_features(spark, folder), "item_id", "video_id"),
    ):
        table.withColumnRenamed(key, source_key).write.option("header", True).csv(f"{root}/data/{name}")
    users, items = sources.load_features(spark, root)
    found = _unpivoted(users, "user", "user_id", *USER_COLUMNS)
    return found.unionByName(_unpivoted(items, "item", "item_id", *ITEM_COLUMNS))


@query
def splits_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The CSV splits read back, with the tie key that orders equal times."""
    path = scratch_path(spark, "csv-splits")
    sinks.write_splits_csv(X.orders_logs(spark, folder).split(), path)
    rows = sources.read_splits_csv(spark, path).stacked()
    columns = ("split", "user_id", "item_id", "event_time", "label", "tie.l_orderkey", "tie.l_linenumber", "tie.l_suppkey")
    return _timed(rows.select(*columns), "event_time")


@query
def split_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    sinks.write_splits(X.orders_logs(spark, folder).split(), path)
    stacked = sources.load_prepared(spark, path).stacked()
    rows = stacked.select("split", "user_id", "item_id", "event_time", "label")
    return _timed(rows, "event_time")


# Rows and pairs


@query
def positives(spark: SparkSession, folder: str) -> DataFrame:
    log = X.orders_log(spark, folder)
    rows = pairs.positives(log).select("user_id", "item_id", "event_time", "label")
    return _timed(rows, "event_time")


@query
def strict_future(spark: SparkSession, folder: str) -> DataFrame:
    logs = X.orders_logs(spark, folder)
    later = cuts.strict_future(logs.history, logs.future)
    return _timed(later.select("user_id", "item_id", "event_time", "label"), "event_time")


@query
def positive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.positive_pairs(X.orders_log(spark, folder))


@query
def first_positive(spark: SparkSession, folder: str) -> DataFrame:
    firsts = pairs.first_positive(X.orders_log(spark, folder))
    rows = firsts.select(
        "user_id", "item_id", "event_time", "tie.l_orderkey", "tie.l_linenumber"
    )
    return _timed(rows, "event_time")


@query
def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.catalog(_train(spark, folder))


@query
def id_map(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.id_map(X.orders_log(spark, folder), "item_id")


@query
def sample_users(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.sample_users(pairs.positive_pairs(_train(spark, folder)), 500, SEED)


@query
def seen_counts(spark: SparkSession, folder: str) -> DataFrame:
    seen = pairs.positive_pairs(X.events_log(spark, folder))
    return pairs.user_activity(seen)


@query
def user_activity(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.user_activity(pairs.positive_pairs(_train(spark, folder)))


@query
def item_popularity(spark: SparkSession, folder: str) -> DataFrame:
    log = _train(spark, folder)
    return pairs.item_popularity(pairs.positive_pairs(log), pairs.catalog(log))


@query
def popularity_norm(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(_train(spark, folder))
    share = pairs.popularity_share(data.popularity)
    return _digits(share.select("item_id", "share"), "share")


# Splits


def _split_rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    part = getattr(X.orders_logs(spark, folder).split(), name)
    rows = part.select(
        "user_id", "item_id", "event_time", "label", "tie.l_orderkey", "tie.l_linenumber"
    )
    return _timed(rows, "event_time")


@query
def split_validation(spark: SparkSession, folder: str) -> DataFrame:
    return _split_rows(spark, folder, "validation")


@query
def split_test(spark: SparkSession, folder: str) -> DataFrame:
    return _split_rows(spark, folder, "test")


@query
def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    splits = X.orders_logs(spark, folder).split()
    summary = _timed(cuts.split_summary(splits.stacked()), "start_time", "end_time")
    return _digits(summary, "positive_rate")


# Truth


@query
def truth_warm(spark: SparkSession, folder: str) -> DataFrame:
    splits = X.orders_logs(spark, folder).split()
    return pairs.warm_start(pairs.positive_pairs(splits.test), pairs.catalog(splits.train))


@query
def truth_novel(spark: SparkSession, folder: str) -> DataFrame:
    splits = X.orders_logs(spark, folder).split()
    return pairs.novel(
        pairs.positive_pairs(splits.test), pairs.positive_pairs(splits.train)
    )


@query
def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    return _case(spark, folder).truth["validation"]


@query
def evaluated_users(spark: SparkSession, folder: str) -> DataFrame:
    case = _case(spark, folder)
    return pairs.evaluated_users(pairs.users_of(case.data.seen), case.truth["validation"])


# Features


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    users = pairs.users_of(X.orders_log(spark, folder))
    return features.attach_features(users, X.customer_features(spark, folder), "user_id")


@query
def feature_join(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """Items with features; the size of every seventh one is text that is no number."""
    items = X.orders_log(spark, folder).select("item_id").distinct()
    table = X.part_features(spark, folder)
    size = F.when(F.col("item_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string"))
    return features.attach_features(items, table.withColumn("size", size), "item_id")


@query
def categorical_codes(spark: SparkSession, folder: str) -> DataFrame:
    sides = (
        ("user", "user_id", _customers(spark, folder), USER_COLUMNS[0]),
        ("item", "item_id", _parts(spark, folder), ITEM_COLUMNS[0]),
    )
    found = [
        features.category_codes(table, key, list(columns)).select(
            F.lit(side).alias("side"), F.col(key).alias("id"), "feature", "value", "code"
        )
        for side, key, table, columns in sides
    ]
    return found[0].unionByName(found[1])


@query
def numeric_features(spark: SparkSession, folder: str) -> DataFrame:
    users = features.numeric_features(_customers(spark, folder), "user_id", list(USER_COLUMNS[1]))
    items = features.numeric_features(_parts(spark, folder), "item_id", list(ITEM_COLUMNS[1]))
    found = _unpivoted(users, "user", "user_id", (), USER_COLUMNS[1])
    found = found.unionByName(_unpivoted(items, "item", "item_id", (), ITEM_COLUMNS[1]))
    return _digits(found.drop("value"), "number")


@query
def causal_history(spark: SparkSession, folder: str) -> DataFrame:
    firsts = pairs.first_positive(_train(spark, folder))
    histories = features.causal_history(firsts, HISTORY)
    return histories.select("user_id", "item_id", _listed("history"))


@query
def strict_history(spark: SparkSession, folder: str) -> DataFrame:
    """Histories without items of the same time; many orders share a date."""
    firsts = pairs.first_positive(_train(spark, folder))
    histories = features.causal_history(firsts, HISTORY, strict_time=True)
    return histories.select("user_id", "item_id", _listed("history"))


@query
def serving_history(spark: SparkSession, folder: str) -> DataFrame:
    firsts = pairs.first_positive(_train(spark, folder))
    return features.serving_history(firsts, HISTORY).select("user_id", _listed("history"))


def _pooled_clicks(spark: SparkSession, folder: str) -> DataFrame:
    firsts = pairs.first_positive(X.events_log(spark, folder))
    recent = features.serving_history(firsts, HISTORY)
    return features.pool_history(recent, _embeddings(spark, folder, "item_id"), 64)


@query
def history_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = _pooled_clicks(spark, folder)
    return _digits(
        pooled.select("user_id", F.posexplode("pooled").alias("dimension", "value")), "value"
    )


@query
def unit_norm(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _embeddings(spark, folder, "vec_id")
    units = vectors.select("vec_id", unit(F.transform("vector", lambda x: x * 3.0)).alias("unit"))
    flat = units.select(
        "vec_id", F.round(norm(F.col("unit")), 6).alias("norm"),
        F.posexplode("unit").alias("dimension", "value"),
    )
    return _digits(flat, "value")


@query
def in_batch_loss(spark: SparkSession, folder: str) -> DataFrame:
    clicks = pairs.positive_pairs(X.events_log(spark, folder))
    users = _pooled_clicks(spark, folder).select("user_id", unit(F.col("pooled")).alias("user_vector"))
    items = _embeddings(spark, folder, "item_id").select(
        "item_id", F.col("vector").cast("array<double>").alias("item_vector")
    )
    rows = clicks.join(users, "user_id").join(items, "item_id")
    losses = retrieval.in_batch_loss(rows, 0.07, 128, [F.col("user_id"), F.col("item_id")])
    return _digits(losses, "loss")


# Ranking and recommenders


@query
def topk_per_user(spark: SparkSession, folder: str) -> DataFrame:
    log = X.events_log(spark, folder).join(
        X.table(spark, folder, "events").select("event_id", "value"),
        F.col("tie") == F.col("event_id"),
    )
    scores = log.groupBy("user_id", "item_id").agg(F.avg("value").alias("score"))
    places = pairs.training(log).popularity.select("item_id", "place")
    return _digits(top_k(scores.join(places, "item_id"), K), "score")


@query
def popularity_rank(spark: SparkSession, folder: str) -> DataFrame:
    return popularity_ranking(item_popularity(spark, folder))


@query
def popularity_topk(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(_train(spark, folder))
    model = PopularityRecommender().fit_training(data)
    return model.recommend(pairs.users_of(X.orders_log(spark, folder)), K)


@query
def fallback_topk(spark: SparkSession, folder: str) -> DataFrame:
    log = X.orders_log(spark, folder)
    data = pairs.training(_train(spark, folder))
    cold = pairs.users_of(log).join(data.seen, "user_id", "left_anti")
    lists = first_unseen(cold, data.seen, data.popularity, K)
    return lists.select("user_id", "rank", "item_id")


def _neighbors(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(_train(spark, folder))
    return itemcf.cosine_neighbors(data.seen, data.popularity, NEIGHBORS)


@query
def nearest_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbors(spark, folder).select("item_id", "neighbor_id", "co_count")


@query
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return itemcf.cooccurrences(pairs.training(_train(spark, folder)).seen)


@query
def cooccurrence_all(spark: SparkSession, folder: str) -> DataFrame:
    """The former name of `cooccurrence`."""
    return cooccurrence(spark, folder)


@query
def item_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    nearest = _neighbors(spark, folder).select("item_id", "rank", "neighbor_id", "similarity")
    return _digits(nearest, "similarity")


@query
def itemcf_scores(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(X.events_log(spark, folder))
    near = itemcf.cosine_neighbors(data.seen, data.popularity, K)
    scores = itemcf.neighbor_scores(data.seen, near)
    return _digits(scores.select("user_id", "item_id", "score"), "score")


@query
def itemcf_topk(spark: SparkSession, folder: str) -> DataFrame:
    model = itemcf.ItemCFRecommender(NEIGHBORS).fit(_train(spark, folder))
    lists = model.recommend(pairs.users_of(X.orders_log(spark, folder)), K)
    return _digits(lists, "score")


@query
def itemcf_topk_events(spark: SparkSession, folder: str) -> DataFrame:
    log = X.events_logs(spark, folder).history
    lists = itemcf.ItemCFRecommender(K).fit(log).recommend(pairs.users_of(log), K)
    return _digits(lists, "score")


@query
def dot_topk(spark: SparkSession, folder: str) -> DataFrame:
    users = _embeddings(spark, folder, "user_id")
    vectors = _embeddings(spark, folder, "item_id")
    places = popularity_ranking(vectors.select("item_id", F.lit(0).alias("popularity")))
    items = vectors.join(places, "item_id")
    same = users.select("user_id", F.col("user_id").alias("item_id"))
    return _digits(retrieval.inner_product_top_k(users, items, same, K), "score")


@query
def bpr_eligible(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(X.events_log(spark, folder))
    return bpr.eligible_pairs(data.seen, data.popularity.count())


@query
def bpr_negatives(spark: SparkSession, folder: str) -> DataFrame:
    data = pairs.training(_train(spark, folder))
    n_catalog = data.popularity.count()
    eligible = materialize(bpr.eligible_pairs(data.seen, n_catalog))
    positions, spans = bpr.catalog_parts(data.items, PARTS, 0)
    return bpr.sample_negatives(eligible, data.seen, positions, spans, PARTS, SEED, 0)


@query
def bpr_topk(spark: SparkSession, folder: str) -> DataFrame:
    log = _train(spark, folder)
    model = bpr.BPRRecommender(factors=16, epochs=2, learning_rate=0.05, seed=SEED).fit(log)
    return model.recommend(pairs.users_of(log), K)


def _hashed(text: Column) -> Column:
    """A number from -0.5 to 0.5 that SQL can draw as well."""
    return text_code(text) / float(1 << 60) - 0.5


def _hashed_state(keys: DataFrame, width: int) -> DataFrame:
    entries = [_hashed(F.concat_ws(":", "kind", "key", F.lit(place))) for place in range(width)]
    return keys.select("kind", "key", F.array(*entries).alias("vector"))


@query
def bpr_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors and the loss after one epoch from hashed vectors, a step per block."""
    data = pairs.training(_train(spark, folder))
    eligible = materialize(bpr.eligible_pairs(data.seen, data.popularity.count()))
    model = bpr.BPRRecommender(factors=FACTORS, learning_rate=0.05, regularization=0.01, batch_size=1 << 30, seed=SEED)
    kinds = (("user", eligible.select("user_id").distinct()), ("item", data.items))
    keys = [ids.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("string").alias("key")) for kind, ids in kinds]
    state = _hashed_state(keys[0].unionByName(keys[1]), FACTORS)
    state = model.train_epoch(data, eligible, state, PARTS)
    rows = state.withColumn("vector", F.when(F.col("kind") == "stat", F.array(F.col("vector")[0] / F.col("vector")[1])).otherwise(F.col("vector")))
    return _digits(rows.select("kind", "key", F.posexplode("vector").alias("place", "value")), "value")


def _feature_sets(spark: SparkSession, folder: str) -> tuple[Features, Features]:
    return (
        Features(X.customer_features(spark, folder), *USER_COLUMNS),
        Features(X.part_features(spark, folder), *ITEM_COLUMNS),
    )


def _two_tower(spark: SparkSession, folder: str, epochs: int) -> TwoTowerRecommender:
    model = TwoTowerRecommender(
        embedding_dim=16, hidden_dim=32, feature_dim=8, epochs=epochs, learning_rate=0.01, seed=SEED
    )
    return model.fit(_train(spark, folder), "label", *_feature_sets(spark, folder))


@query
def two_tower_topk(spark: SparkSession, folder: str) -> DataFrame:
    model = _two_tower(spark, folder, 2)
    return model.recommend(pairs.users_of(X.orders_log(spark, folder)), K)


@query
def train_loss(spark: SparkSession, folder: str) -> DataFrame:
    losses = _two_tower(spark, folder, 3).losses
    return spark.range(1).select(
        F.posexplode(F.array(*[F.lit(loss) for loss in losses])).alias("epoch", "loss")
    )


def _hashed_tower(spark: SparkSession, folder: str, **settings) -> TwoTowerRecommender:
    """A small model with features and history, and hashed parameters to start from."""
    model = TwoTowerRecommender(embedding_dim=3, hidden_dim=4, feature_dim=2, max_history=HISTORY, seed=SEED, **settings)
    model.prepare(_train(spark, folder), "label", *_feature_sets(spark, folder))
    ids, values = model.state_keys()
    model.start = materialize(_hashed_state(ids, 3).unionByName(_hashed_state(values, 2)))

    def drawn(text: str) -> float:
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) / float(1 << 60) - 0.5

    model.drawn = {}
    for name, (rows, columns) in model.layers().items():
        cells = [[drawn(f"{name}:{row}:{column}") for column in range(columns)] for row in range(rows)]
        model.drawn[f"{name}_w"] = np.array(cells)
        model.drawn[f"{name}_b"] = np.array([drawn(f"{name}:b:{column}") for column in range(columns)])
    return model


@query
def tower_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors of all items and users with positives, from hashed parameters."""
    model = _hashed_tower(spark, folder)
    model.loaded(model.start, model.drawn)
    users = model.user_vectors(pairs.users_of(model.data.seen))
    found = [
        vectors.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), F.posexplode("vector").alias("place", "value"))
        for side, vectors in (("item", model.item_vectors), ("user", users))
    ]
    return _digits(found[0].unionByName(found[1]), "value", digits=5)


@query
def first_epoch_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Mean loss of an epoch of one round with a batch per block, from hashed parameters."""
    model = _hashed_tower(spark, folder, epochs=1, rounds=1, block_rows=400, batch_size=1 << 20)
    model.train(model.start, model.drawn)
    return spark.range(1).select(F.lit(model.n_blocks).alias("blocks"), F.round(F.lit(model.losses[0]), 4).alias("loss"))


# Metrics


@query
def hits(spark: SparkSession, folder: str) -> DataFrame:
    case = _case(spark, folder)
    return metrics.hits(_popular(case), case.truth["validation"])


def _per_user(spark: SparkSession, folder: str, name: str) -> DataFrame:
    case = _case(spark, folder)
    rows = metrics.user_metrics(
        _popular(case), case.truth["validation"], case.users["validation"], [K]
    )
    return _digits(rows.select("user_id", name), name)


@query
def eval_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _per_user(spark, folder, "recall")


@query
def eval_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _per_user(spark, folder, "hit_rate")


@query
def eval_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return _per_user(spark, folder, "ndcg")


@query
def eval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    case = _case(spark, folder)
    covered = metrics.coverage(
        _popular(case), case.truth["validation"], case.users["validation"], [K],
        case.data.items.count(),
    )
    return _digits(covered, "coverage")


def _evaluated(spark: SparkSession, folder: str, ks: list[int]) -> DataFrame:
    case = _case(spark, folder)
    found = metrics.evaluate(
        _popular(case), case.truth["validation"], case.users["validation"], case.data.items, ks
    )
    return _digits(found, *metrics.METRICS, "coverage")


@query
def evaluate(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, [K])


@query
def evaluate_multi_k(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, KS)


# Segments


@query
def activity_cuts(spark: SparkSession, folder: str) -> DataFrame:
    cut = segments.activity_cuts(pairs.positive_pairs(_train(spark, folder)))
    return _cut_rows(spark, cut)


@query
def popularity_cuts(spark: SparkSession, folder: str) -> DataFrame:
    cut = segments.popularity_cuts(item_popularity(spark, folder))
    return _cut_rows(spark, cut)


def _cut_rows(spark: SparkSession, cut: list[float]) -> DataFrame:
    return spark.range(1).select(F.lit(cut[0]).alias("low"), F.lit(cut[1]).alias("high"))


@query
def user_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.user_segments(pairs.positive_pairs(_train(spark, folder)))


@query
def item_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.item_segments(item_popularity(spark, folder))


@query
def user_segment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    known = user_segments(spark, folder)
    return segments.user_segment_lookup(pairs.users_of(X.orders_log(spark, folder)), known)


@query
def evaluate_user_segments(spark: SparkSession, folder: str) -> DataFrame:
    case = _case(spark, folder)
    known = segments.user_segments(case.data.seen)
    rows = segments.evaluate_user_segments(
        _popular(case), case.truth["validation"], case.users["validation"], known,
        case.data.items, K,
    )
    return _digits(rows, *metrics.METRICS, "coverage")


@query
def evaluate_item_segments(spark: SparkSession, folder: str) -> DataFrame:
    case = _case(spark, folder)
    known = segments.item_segments(case.data.popularity)
    rows = segments.evaluate_item_segments(
        _popular(case), case.truth["validation"], case.users["validation"], known, K
    )
    return _digits(rows, *metrics.METRICS, "recommendation_share", "group_coverage")


# Jobs


def _benchmark(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """All three result tables of the job as rows, told apart by `part`."""
    config = {
        "seed": SEED,
        "evaluation": {"k": K, "max_users": None},
        "models": {
            "itemcf": {"neighbor_k": NEIGHBORS},
            "bpr": {"factors": 16, "epochs": 2, "learning_rate": 0.05},
        },
    }
    splits = X.orders_logs(spark, folder).split()
    every = jobs.default_models(config["models"], SEED)
    found = jobs.run_benchmark(splits, config, {name: every[name] for name in names})
    shares = ("recommendation_share", "group_coverage")
    columns = ["model", "split", "k", *metrics.METRICS, "coverage", *shares, "evaluated_users"]

    def rows(part: str, table: DataFrame, segment: Column) -> DataFrame:
        lacking = {name: F.lit(None).cast("double") for name in columns if name not in table.columns}
        return table.withColumns(lacking).select(F.lit(part).alias("part"), segment.alias("segment"), *columns)

    stacked = rows("overall", found.overall, F.lit("all"))
    stacked = stacked.unionByName(rows("user", found.user_activity, F.col("segment")))
    stacked = stacked.unionByName(rows("item", found.item_popularity, F.col("segment")))
    return _digits(stacked, *metrics.METRICS, "coverage", *shares)


@query
def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return _benchmark(spark, folder, ("popularity", "itemcf"))


@query
def benchmark_bpr(spark: SparkSession, folder: str) -> DataFrame:
    return _benchmark(spark, folder, ("bpr",))


@query
def retrieval_variants(spark: SparkSession, folder: str) -> DataFrame:
    splits = X.orders_logs(spark, folder).split()
    found = []
    for with_features in (False, True):
        for with_history in (False, True):
            kinds = [kind for kind, used in (("feature", with_features), ("history", with_history)) if used]
            config = {
                "seed": SEED,
                "evaluation": {"k_values": [50, 100], "max_users": None},
                "experiment": {
                    "variant": "_".join(kinds) or "id_only",
                    "use_user_features": with_features,
                    "use_item_features": with_features,
                    "use_history": with_history,
                },
                "model": {"embedding_dim": 16, "hidden_dim": 32, "feature_dim": 8, "epochs": 2},
            }
            run = jobs.run_retrieval(splits, config, *_feature_sets(spark, folder))
            found.append(run.metrics.drop(*RUN_TIMES))
    return _digits(reduce(DataFrame.unionByName, found), *metrics.METRICS, "coverage")
