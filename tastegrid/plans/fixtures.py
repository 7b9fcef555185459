"""Interaction logs over the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators.splits import Splits, split_future


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Logs:
    """History, raw future and random-exposure logs; history and future overlap."""

    history: DataFrame
    future: DataFrame
    audit: DataFrame

    def split(self, fraction: float = 0.5) -> Splits:
        return split_future(self.history, self.future, self.audit, fraction)


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    """Customers buying parts; a returned line is a negative."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").alias("event_time"),
        (F.col("l_returnflag") != "R").cast("int").alias("label"),
        tie.alias("tie"),
        F.col("l_linestatus").alias("context"),
    )


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """Users meeting items; a click is a positive."""
    return table(spark, folder, "events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("ts").alias("event_time"),
        (F.col("event_type") == "click").cast("int").alias("label"),
        F.col("event_id").alias("tie"),
        F.col("event_type").alias("context"),
    )


def orders_logs(spark: SparkSession, folder: str) -> Logs:
    return _logs(orders_log(spark, folder), "1999-01-01 00:00:00", "1998-12-25 00:00:00", "O")


def events_logs(spark: SparkSession, folder: str) -> Logs:
    return _logs(events_log(spark, folder), "2024-01-19 00:00:00", "2024-01-18 12:00:00", "view")


def _logs(log: DataFrame, history_end: str, future_start: str, audit: str) -> Logs:
    columns = ["user_id", "item_id", "event_time", "label", "tie"]
    time = F.col("event_time")

    def moment(text: str) -> Column:
        return F.lit(text).cast(log.schema["event_time"].dataType)

    future = log.filter(time >= moment(future_start))
    return Logs(
        log.filter(time < moment(history_end)).select(*columns),
        future.select(*columns),
        future.filter(F.col("context") == audit).select(*columns),
    )


def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    """User features; a HOUSEHOLD segment and a negative balance count as unknown."""
    balance = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.when(balance >= 0, balance).alias("balance"),
    )


def part_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )
