"""Positions and order statistics without a one-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.session import materialize

_POSITION_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id


def ordered_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Add each row's 0-based position in a total order.

    Rows are range-partitioned by the order, so equal-sized partitions hold
    consecutive runs even when one key owns most rows. The stamped rows are
    written once: range bounds come from a sample, and a second evaluation
    could draw them elsewhere.
    """
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stamped = materialize(
        runs.withColumn("_run", F.spark_partition_id()).withColumn(
            "_offset", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS))
        )
    )
    # One row per partition comes back, whatever the number of rows.
    sizes = dict(stamped.groupBy("_run").count().collect())
    starts = [0]
    for run in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(run, 0))
    listed = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    return stamped.withColumn(name, F.get(listed, F.col("_run")) + F.col("_offset")).drop(
        "_run", "_offset"
    )


def count_quantiles(counts: DataFrame, column: str, levels: list[float]) -> list[float]:
    """Interpolated quantiles of an integer count column, rounded to 9 digits.

    The counts shrink to a histogram first. Counts that sum to P take at most
    sqrt(2 P) distinct values, so the exact percentile sees few rows.
    """
    histogram = counts.groupBy(column).agg(F.count(F.lit(1)).alias("_weight"))
    listed = ", ".join(f"CAST({level!r} AS DOUBLE)" for level in levels)
    row = histogram.agg(
        F.expr(f"percentile(`{column}`, array({listed}), _weight)").alias("cuts")
    ).first()
    return [round(cut, 9) for cut in row["cuts"]]


def exact_medians(df: DataFrame, columns: list[str], bins: int = 1024) -> dict[str, float | None]:
    """Exact median of each column of finite doubles; nulls are left out.

    Each pass counts the values of all columns in equal bins between the
    bounds known so far. Count, least and largest value of each bin, at most
    `bins` rows per column, come to the driver; the bin that holds the middle
    gives the next bounds. Its least and largest value part in every pass.
    """
    bounds = df.agg(*[F.struct(F.count(name), F.min(name), F.max(name)) for name in columns]).first()
    medians: dict[str, float | None] = {}
    open_: dict[str, tuple[float, float, int, int]] = {}  # bounds, values below, values in all
    for name, (total, low, high) in zip(columns, bounds):
        if not total or low == high:
            medians[name] = low
        else:
            open_[name] = low, high, 0, total
    while open_:
        cells = F.array(*[_cell(name, low, high, bins) for name, (low, high, *_) in open_.items()])
        counted = (
            df.select(F.explode(cells).alias("cell")).where("cell.bin IS NOT NULL")
            .groupBy("cell.name", "cell.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("cell.value").alias("low"), F.max("cell.value").alias("high"))
        )
        found: dict[str, list] = {name: [] for name in open_}
        for row in counted.collect():
            found[row["name"]].append(row)
        for name, rows in found.items():
            _, _, through, total = open_.pop(name)
            lower, upper = (total - 1) // 2, total // 2
            for row in sorted(rows, key=lambda row: row["bin"]):
                before, through = through, through + row["n"]
                if lower < before == upper:  # the lower middle is the largest value so far
                    medians[name] = (largest + row["low"]) / 2.0
                    break
                if upper < through and (row["low"] == row["high"]):
                    medians[name] = row["low"]
                    break
                if lower < through and upper < through:
                    open_[name] = row["low"], row["high"], before, total
                    break
                largest = row["high"]
    return {name: medians[name] for name in columns}


def _cell(name: str, low: float, high: float, bins: int) -> Column:
    """Name, value and bin of a column's value; no bin outside the bounds."""
    value = F.col(name)
    part = 1.0 if math.isfinite(high - low) else 0.5  # the distance of two doubles may be none
    share = (value * part - F.lit(low * part)) / F.lit(high * part - low * part)
    place = F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return F.struct(F.lit(name).alias("name"), F.when(value.between(low, high), place).alias("bin"), value.alias("value"))
