"""Chronological splits that keep the future out of training."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions.columns import literal_of
from tastegrid.operators.ordering import ordered_index

_BINS = 4096
SPLITS = ("train", "validation", "test", "random_audit")


@dataclass(frozen=True)
class Splits:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    random_audit: DataFrame

    def stacked(self) -> DataFrame:
        """One long table with a split column."""
        frames = [getattr(self, name).withColumn("split", F.lit(name)) for name in SPLITS]
        stacked = frames[0]
        for frame in frames[1:]:
            stacked = stacked.unionByName(frame, allowMissingColumns=True)
        return stacked


def strict_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """Future rows later than the last history row.

    The bound becomes a literal, so the filter reaches the future's scan.
    """
    last = history.agg(F.max("event_time").cast("string")).first()[0]
    return future.filter(F.col("event_time") > literal_of(last, _time_type(future)))


def split_future(
    history: DataFrame, future: DataFrame, audit: DataFrame, fraction: float = 0.5
) -> Splits:
    """Train on history; cut the strict future by row count along time."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be strictly between 0 and 1")
    validation, test = cut_in_time(strict_future(history, future), fraction)
    return Splits(history, validation, test, audit)


def cut_in_time(log: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    """The earliest floor(n * fraction) rows, at least 1, at most n - 1, and the rest.

    Counts in bins of time locate the bin that holds the cut. Only that bin is
    ordered, in range partitions, and the rows at the cut come back. Where
    rows equal in time and tie lie on both sides, they are numbered by all
    their columns, and as many go to the front as the cut asks for.
    """
    bin_of = _bins(log)
    counted = log.groupBy(bin_of.alias("bin")).count().collect()  # _BINS rows, or one per day
    sizes = sorted((row["bin"], row["count"]) for row in counted)
    total = sum(size for _, size in sizes)
    if total < 2:
        raise ValueError("a chronological split needs at least two future rows")
    remaining = min(max(math.floor(total * fraction), 1), total - 1)
    for key, size in sizes:
        if remaining < size:
            break
        remaining -= size
    in_bin = log.filter(bin_of == F.lit(key))
    moment = F.struct("event_time", "tie").alias("moment")
    ordered = ordered_index(in_bin.select(moment), [F.col("moment")])
    bounds = _bound_fields(log)
    texts = [F.col(path).cast("string").alias(f"b{at}") for at, (path, _) in enumerate(bounds)]
    rows = ordered.filter(F.col("index").isin(remaining - 1, remaining)).orderBy("index")
    found = [tuple(row) for row in rows.select(*texts).collect()]
    first_after = found[-1]
    time_bound = literal_of(first_after[0], bounds[0][1])
    tie_bound = _tie_literal(log, first_after[1:])
    time = F.col("event_time")
    before = (time < time_bound) | ((time == time_bound) & (F.col("tie") < tie_bound))
    if len(set(found)) == len(found):
        return log.filter(before), log.filter(~before)
    equal = (time == time_bound) & (F.col("tie") == tie_bound)
    wanted = remaining - in_bin.filter(before).count()
    numbered = ordered_index(log.filter(equal), [F.struct(*log.columns)], "__copy")
    columns = log.columns
    return (
        log.filter(before).unionByName(numbered.filter(F.col("__copy") < wanted).select(*columns)),
        log.filter(~before & ~equal).unionByName(
            numbered.filter(F.col("__copy") >= wanted).select(*columns)
        ),
    )


def _bins(log: DataFrame) -> Column:
    """Days, or for numbers of any unit _BINS equal steps from the first to the last."""
    data_type, time = _time_type(log), F.col("event_time")
    if not isinstance(data_type, T.NumericType):
        return F.to_date(time)
    low, high = log.agg(F.min(time), F.max(time)).first()
    if low is None or low == high:
        return F.lit(0)
    if isinstance(data_type, T.IntegralType):
        step = (high - low) // _BINS + 1
        return F.expr(f"(cast(event_time as decimal(20, 0)) - {low}) div {step}")
    return F.floor((time.cast("double") - float(low)) / ((float(high) - float(low)) / _BINS))


def split_summary(stacked: DataFrame) -> DataFrame:
    """Rows, users, items, time range and mean label per split."""
    return stacked.groupBy("split").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        F.min("event_time").alias("start_time"),
        F.max("event_time").alias("end_time"),
        F.avg("label").alias("positive_rate"),
    )


def _time_type(log: DataFrame) -> T.DataType:
    return log.schema["event_time"].dataType


def _bound_fields(log: DataFrame) -> list[tuple[str, T.DataType]]:
    fields = [("moment.event_time", _time_type(log))]
    tie_type = log.schema["tie"].dataType
    if isinstance(tie_type, T.StructType):
        fields += [(f"moment.tie.{field.name}", field.dataType) for field in tie_type]
    else:
        fields.append(("moment.tie", tie_type))
    return fields


def _tie_literal(log: DataFrame, texts: tuple) -> Column:
    tie_type = log.schema["tie"].dataType
    if not isinstance(tie_type, T.StructType):
        return literal_of(texts[0], tie_type)
    return F.struct(
        *[
            literal_of(text, field.dataType).alias(field.name)
            for text, field in zip(texts, tie_type)
        ]
    )
