"""Top-k lists, the global popularity ranking and unseen-item selection.

Every ordering is total: score rounded to 9 digits, then popularity, both
descending, then the item id as text. The last two are one number, the item's
place in the popularity ranking, so lists are sorted on numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.columns import is_finite
from tastegrid.operators.ordering import ordered_index
from tastegrid.session import materialize

_LIMITED = "spark.sql.optimizer.windowGroupLimitThreshold"
HEAD_SIZE = 65_536  # ranks kept in the broadcast head; a few MB at most


def score_order() -> list[Column]:
    return [F.rint(F.col("score") * 1e9).desc(), F.col("place").asc()]


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best finite scores per user as (user_id, rank, item_id, score).

    `scores` has user_id, item_id, score and place. The rank limit runs
    before the shuffle too, so a user with many candidates sends k rows per
    map task. Spark does so up to a k of its session, which is raised to this
    one where it is smaller.
    """
    require_k(k)
    spark = scores.sparkSession
    if int(spark.conf.get(_LIMITED, "1000")) < k:
        spark.conf.set(_LIMITED, str(k))
    by_user = Window.partitionBy("user_id").orderBy(*score_order())
    return (
        scores.filter(is_finite(F.col("score")))
        .withColumn("rank", F.row_number().over(by_user))
        .filter(F.col("rank") <= k)
        .select("user_id", "rank", "item_id", "score")
    )


def popularity_ranking(popularity: DataFrame) -> DataFrame:
    """The whole catalog by popularity, then by id text; place from 1."""
    order = [F.col("popularity").desc(), F.col("item_id").cast("string").asc()]
    ranked = ordered_index(popularity, order)
    return ranked.select("item_id", "popularity", (F.col("index") + 1).alias("place"))


def first_unseen(
    users: DataFrame,
    seen: DataFrame,
    ranking: DataFrame,
    k: int,
    head_size: int = HEAD_SIZE,
) -> DataFrame:
    """The k most popular items each user has not seen, with rank from 1.

    `ranking` has item_id, popularity and place. A broadcast head of the ranking serves nearly everyone. Users whose head
    is used up go through the whole ranking, so no list falls short.
    """
    require_k(k)
    n_items = ranking.count()
    width = min(n_items, max(head_size, k))
    # At most head_size rows, or k if that is larger.
    small = F.broadcast(ranking.filter(F.col("place") <= width))
    taken = seen.join(small, "item_id").select("user_id", "place")
    picks = _open_places(users, taken, width, k)
    if width == n_items:
        return _resolve(picks, small)
    picks = materialize(picks)
    short = picks.filter(F.size("places") < k).select("user_id")
    done = _resolve(picks.filter(F.size("places") >= k), small)
    if short.isEmpty():
        return done
    rest = seen.join(short, "user_id", "left_semi").join(ranking, "item_id")
    deep = _open_places(short, rest.select("user_id", "place"), n_items, k)
    return done.unionByName(_resolve(deep, ranking))


def _open_places(users: DataFrame, taken: DataFrame, n_places: int, k: int) -> DataFrame:
    """The k smallest places in 1..n_places that each user has not taken.

    Taken places fall into buckets of fixed width, which splits a heavy user's
    list. Only the unbroken run of buckets from the start matters: the first
    bucket a user has not touched holds k open places at once.
    """
    width = max(k, 256)
    bucket = F.floor((F.col("place") - 1) / width)
    filled = (
        taken.join(users.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id", bucket.alias("bucket"))
        .agg(F.collect_list("place").alias("taken"))
    )
    by_user = Window.partitionBy("user_id").orderBy("bucket")
    first = F.col("bucket") * width + 1
    last = F.least((F.col("bucket") + 1) * width, F.lit(n_places))
    every = F.sequence(first, last)
    runs = (
        filled.withColumn("position", F.row_number().over(by_user) - 1)
        .filter(F.col("position") == F.col("bucket"))
        .withColumn("open", F.array_except(every, "taken"))
        .withColumn(
            "open_before",
            F.coalesce(
                F.sum(F.size("open")).over(by_user.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .filter(F.col("open_before") < k)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("buckets"),
            F.flatten(
                F.collect_list(F.when(F.size("open") > 0, F.slice("open", 1, k)))
            ).alias("open"),
        )
    )
    start = F.coalesce("buckets", F.lit(0)) * width
    untouched = F.when(
        start < n_places, F.sequence(start + 1, F.least(start + k, F.lit(n_places)))
    ).otherwise(F.array().cast("array<bigint>"))
    found = F.coalesce("open", F.array().cast("array<bigint>"))
    chosen = F.when(F.size(found) < k, F.concat(found, untouched)).otherwise(found)
    return (
        users.select("user_id")
        .join(runs, "user_id", "left")
        .select("user_id", F.slice(F.array_sort(chosen), 1, k).alias("places"))
    )


def _resolve(picks: DataFrame, ranking: DataFrame) -> DataFrame:
    listed = picks.select("user_id", F.posexplode("places").alias("position", "place"))
    return listed.join(ranking, "place").select(
        "user_id",
        (F.col("position") + 1).alias("rank"),
        "item_id",
        F.col("popularity").cast("double").alias("score"),
        "place",
    )


def fill_to_k(
    scored: DataFrame, users: DataFrame, seen: DataFrame, ranking: DataFrame, k: int
) -> DataFrame:
    """Top-k scored items per user; short lists go on with popular unseen items.

    `scored` has user_id, item_id, score > 0 and place, free of seen items.
    """
    require_k(k)
    by_user = Window.partitionBy("user_id").orderBy(*score_order())
    # k rows per user, needed three times below.
    best = materialize(
        scored.withColumn("rank", F.row_number().over(by_user))
        .filter(F.col("rank") <= k)
        .select("user_id", "rank", "item_id", "score", "place")
    )
    full = best.filter(F.col("rank") == k).select("user_id")
    short = users.select("user_id").join(full, "user_id", "left_anti")
    # Fewer than k of these can be scored already, so the rest completes the list.
    popular = first_unseen(short, seen, ranking, k)
    unscored = popular.join(best, ["user_id", "item_id"], "left_anti")
    extra = unscored.select(
        "user_id", "rank", "item_id", F.lit(0.0).alias("score"), "place"
    )
    partial = best.join(short, "user_id", "left_semi").unionByName(extra)
    columns = ["user_id", "rank", "item_id", "score"]
    complete = best.join(full, "user_id", "left_semi").select(*columns)
    return complete.unionByName(top_k(partial, k))


def require_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
