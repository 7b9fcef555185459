"""Written tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCAN_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes that rows take in a join over those of their files: lists sorted by user take under a byte a row there.
FILE_FACTOR = 64


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a new one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tastegrid-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/tastegrid-{run}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it from there.

    This cuts the lineage and survives the loss of executors. Sizes to choose
    joins by need `count_rows_not_files` besides. The shuffles behind the table
    are dropped at once, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs in here deletes its shuffle files when it ends."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def count_rows_not_files(spark: SparkSession) -> None:
    """Have Spark see packed files as large as their rows.

    It takes the size of a file for that of its rows, and would broadcast
    millions of well packed ones. The session's factor between them is raised
    where it is smaller; what Spark knows from a shuffle is not changed.
    """
    if float(spark.conf.get(_SCAN_FACTOR, "1.0")) < FILE_FACTOR:
        spark.conf.set(_SCAN_FACTOR, str(float(FILE_FACTOR)))


def forget(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for these very frames; others are left alone."""
    for table in tables:
        path = getattr(table, "_written", None)
        if path is not None:
            discard(table.sparkSession, path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    hadoop, context = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for path in paths:
        hadoop(path).getFileSystem(context).delete(hadoop(path), True)
