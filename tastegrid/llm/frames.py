"""Column-wise Arrow maps, bounded samples and folds shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tastegrid.session import discard, scratch_path

CHUNK_BYTES = 1 << 18
#: Ids that are broadcast to a join; with more, both sides are shuffled.
BROADCAST_IDS = 500_000
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `materialize` writes inside, at the end.

    What leaves the block must not read them any more.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        discard(spark, *written)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once in the shared folder and read it from there."""
    path = scratch_path(df.sparkSession, "table")
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote before the block around it ends."""
    files = df.inputFiles()
    if files:
        discard(df.sparkSession, files[0].rpartition("/")[0])


def few(ids: DataFrame) -> DataFrame:
    """`ids`, to be broadcast if they are at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def release() -> None:
    """Give memory that this worker holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)


def quoted(name: str) -> str:
    """A column name with any characters as Spark reads it."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(name)) for name in df.columns]


def fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one of `parts`; null ids do."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` rows drawn by a hash of `key`; all rows if there are no more."""
    total = df.count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def add_columns(
    df: DataFrame,
    inputs: list[str],
    function: Callable[[list[pa.Array]], dict[str, pa.Array]],
    added: str,
) -> DataFrame:
    """`df` with the columns that `function` computes from the arrays of `inputs`.

    A column of `df` with the name of an added one is replaced.
    """
    new = StructType.fromDDL(added)
    names = [field.name for field in new]
    kept = [field for field in df.schema if field.name not in names]
    inner = [f"kept{place}" for place in range(len(kept))]
    sources = [f"input{place}" for place in range(len(inputs))]
    frame = df.select(
        *(F.col(quoted(field.name)).alias(alias) for field, alias in zip(kept, inner)),
        *(F.col(quoted(name)).alias(alias) for name, alias in zip(inputs, sources)),
    )
    schema = StructType([StructField(alias, field.dataType) for field, alias in zip([*kept, *new], [*inner, *names])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, sources):
                made = function([piece.column(alias) for alias in sources])
                columns = [piece.column(alias) for alias in inner] + [made[name] for name in names]
                yield pa.RecordBatch.from_arrays(columns, inner + names)

    return frame.mapInArrow(run, schema).toDF(*(field.name for field in kept), *names)


def pieces(batch: pa.RecordBatch, text_columns: list[str], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its texts hold about `most` bytes, a row at least."""
    size = sum(batch.column(name).nbytes for name in text_columns)
    rows = max(1, batch.num_rows * most // max(size, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
    release()
