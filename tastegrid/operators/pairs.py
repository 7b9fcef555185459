"""Positives, catalogs, seen sets and ground truth as long tables.

Logs have the columns user_id, item_id, event_time, label and tie, where tie
makes (event_time, tie) unique and stands for the row order of the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.columns import is_positive
from tastegrid.operators.ordering import ordered_index
from tastegrid.operators.ranking import popularity_ranking
from tastegrid.session import count_rows_not_files, materialize


def positives(log: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a positive label and both ids."""
    keep = is_positive(label, log.schema[label].dataType)
    return log.filter(keep & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())


def positive_pairs(log: DataFrame, label: str = "label") -> DataFrame:
    return positives(log, label).select("user_id", "item_id").distinct()


def first_positive(log: DataFrame, label: str = "label") -> DataFrame:
    """The earliest positive row of each (user, item)."""
    moment = F.struct("event_time", "tie")
    return (
        positives(log, label)
        .groupBy("user_id", "item_id")
        .agg(F.min(moment).alias("first"))
        .select("user_id", "item_id", "first.event_time", "first.tie")
    )


def catalog(log: DataFrame) -> DataFrame:
    """Distinct items of the log, positive or not."""
    return log.filter(F.col("item_id").isNotNull()).select("item_id").distinct()


def id_map(log: DataFrame, column: str) -> DataFrame:
    """Dense index of an id column by first appearance."""
    firsts = (
        log.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(F.struct("event_time", "tie")).alias("first"))
    )
    return ordered_index(firsts, [F.col("first"), F.col(column)]).select(column, "index")


def user_activity(pairs: DataFrame) -> DataFrame:
    """Number of distinct positive items per user."""
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"))


def item_counts(pairs: DataFrame) -> DataFrame:
    """Number of distinct positive users per item that has any."""
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))


def item_popularity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Positive users per catalog item, zero where there are none."""
    return items.join(item_counts(pairs), "item_id", "left").select(
        "item_id", F.coalesce("popularity", F.lit(0)).alias("popularity")
    )


def popularity_share(popularity: DataFrame) -> DataFrame:
    """Popularity divided by the largest one, or by 1."""
    largest = popularity.agg(F.max("popularity")).first()[0] or 0
    return popularity.withColumn("share", F.col("popularity") / F.lit(float(max(largest, 1))))


def warm_start(truth: DataFrame, items: DataFrame) -> DataFrame:
    return truth.join(items, "item_id", "left_semi").select("user_id", "item_id")


def novel(truth: DataFrame, seen: DataFrame) -> DataFrame:
    return truth.join(seen, ["user_id", "item_id"], "left_anti")


def ground_truth(
    log: DataFrame,
    label: str = "label",
    items: DataFrame | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Distinct positive pairs, optionally warm-start and novel only."""
    truth = positive_pairs(log, label)
    if items is not None:
        truth = warm_start(truth, items)
    if seen is not None:
        truth = novel(truth, seen)
    return truth


def users_of(frame: DataFrame) -> DataFrame:
    return frame.select("user_id").distinct()


def sample_users(truth: DataFrame, size: int | None, seed: int) -> DataFrame:
    """All users of the truth, or `size` of them chosen by a seeded hash."""
    users = users_of(truth)
    if size is None:
        return users
    ticket = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.lit(str(seed))))
    return users.orderBy(ticket, "user_id").limit(size)


def evaluated_users(requested: DataFrame, truth: DataFrame) -> DataFrame:
    """Requested users that have any ground truth."""
    return requested.select("user_id").join(users_of(truth), "user_id", "left_semi")


def require_rows(frame: DataFrame, message: str) -> None:
    if frame.isEmpty():
        raise ValueError(message)


@dataclass(frozen=True)
class Training:
    """What every recommender needs from a log, read once and written down.

    `popularity` is the ranked catalog: item_id, popularity and place.
    """

    seen: DataFrame
    popularity: DataFrame

    @property
    def items(self) -> DataFrame:
        return self.popularity.select("item_id")


def training(log: DataFrame, label: str = "label") -> Training:
    """Positive pairs and catalog popularity of a training log."""
    count_rows_not_files(log.sparkSession)
    seen = materialize(positive_pairs(log, label))
    popularity = item_popularity(seen, catalog(log))
    return Training(seen, popularity_ranking(popularity))
