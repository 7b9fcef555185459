"""Writers for splits, summaries and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions.columns import file_stem
from tastegrid.operators.splits import SPLITS, Splits
from tastegrid.sources.logs import CSV_TEXT


def write_splits(splits: Splits, path: str) -> None:
    """All splits as one Parquet table partitioned by split."""
    splits.stacked().write.mode("overwrite").partitionBy("split").parquet(path)


def write_splits_csv(splits: Splits, path: str) -> None:
    """One folder of gzip CSV per split, and their schema; nested columns become JSON text."""
    spark, schema = splits.train.sparkSession, splits.train.schema
    nested = {field.name for field in schema if isinstance(field.dataType, T.StructType)}
    for name in SPLITS:
        frame = getattr(splits, name).select(
            *(F.to_json(column).alias(column) if column in nested else F.col(column) for column in schema.names)
        )
        writer = frame.write.mode("overwrite").option("header", True).options(**CSV_TEXT)
        writer.option("compression", "gzip").csv(f"{path}/{name}.csv.gz")
    spark.range(1).select(F.lit(schema.json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def write_summary(summary: DataFrame, path: str) -> None:
    _one_file(summary).json(f"{path}/summary.json")


def write_benchmark(results, path: str) -> None:
    """Overall rows as JSON and CSV, and CSV for either kind of segment."""
    _one_file(results.overall).json(f"{path}/week1_results.json")
    _one_file(results.overall).option("header", True).csv(f"{path}/week1_results.csv")
    _one_file(results.user_activity).option("header", True).csv(f"{path}/week1_user_activity.csv")
    _one_file(results.item_popularity).option("header", True).csv(
        f"{path}/week1_item_popularity.csv"
    )


def write_retrieval(results, path: str) -> str:
    """Metric rows as JSON and CSV under the variant's safe name; returns the stem."""
    safe = results.metrics.sparkSession.range(1).select(file_stem(results.variant)).first()[0]
    stem = f"week2_{safe}_results"
    whole = results.metrics.withColumn(
        "training_loss", F.array(*[F.lit(loss) for loss in results.training_loss])
    )
    _one_file(whole).json(f"{path}/{stem}.json")
    _one_file(results.metrics).option("header", True).csv(f"{path}/{stem}.csv")
    return stem


def _one_file(frame: DataFrame):
    # Result tables have one row per model, split, segment and k.
    return frame.coalesce(1).write.mode("overwrite")
