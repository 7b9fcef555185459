"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__MISSING__"  # fixed value: the category of an absent feature


def is_positive(label: str, data_type: T.DataType) -> Column:
    """`label > 0`; a NaN label is not positive."""
    positive = F.col(label) > 0
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        positive = positive & ~F.isnan(label)
    return positive


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def to_number(column: str) -> Column:
    """Numeric value of a column; text that is no number becomes null."""
    return F.expr(f"try_cast(`{column}` AS DOUBLE)")


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def clip_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def discount(rank: Column) -> Column:
    """Gain of a hit at `rank`, counted from 1."""
    return 1.0 / F.log2(rank + 1.0)


def ideal_gain(length: Column) -> Column:
    """Sum of the first `length` discounts."""
    ranks = F.sequence(F.lit(1), length.cast("int"))
    total = F.aggregate(ranks, F.lit(0.0), lambda acc, rank: acc + discount(rank))
    return F.when(length > 0, total).otherwise(F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """L2-normalized copy; a zero vector stays zero."""
    size = F.greatest(norm(vector), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / size)


def tail(array: Column, size: int) -> Column:
    """The last `size` entries of an array."""
    length = F.size(array)
    return F.slice(array, F.greatest(length - size + 1, F.lit(1)), F.lit(size))


def file_stem(name: str) -> Column:
    """A variant name made safe for file names."""
    return F.regexp_replace(F.lit(name), "[^a-zA-Z0-9_-]+", "_")


def literal_of(text: str | None, data_type: T.DataType) -> Column:
    """A literal of `data_type` from its text form."""
    return F.lit(text).cast(data_type)


def dimensions(column: Column, width: int) -> list[Column]:
    """The entries of an array as columns; null past its end."""
    return [F.get(column, F.lit(position)) for position in range(width)]


def vector_sum(column: Column, width: int) -> Column:
    """Element-wise sum of arrays, added up before the shuffle."""
    totals = [F.sum(entry) for entry in dimensions(column, width)]
    return F.array_compact(F.array(*totals))


def vector_mean(column: Column, width: int) -> Column:
    """Element-wise mean of arrays, added up before the shuffle."""
    return F.array(*[F.avg(entry) for entry in dimensions(column, width)])


def text_code(*parts: Column) -> Column:
    """A 60-bit number from the text of values, alike in every engine with md5."""
    text = F.concat_ws(":", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def gaussian_vector(key: Column, width: int, scale: float, seed: int) -> Column:
    """A normal draw per dimension that depends on the key and seed alone."""

    def uniform(position: Column, stream: int) -> Column:
        bits = F.xxhash64(key, position, F.lit(stream), F.lit(seed))
        return (F.shiftrightunsigned(bits, 11) + 0.5) / float(1 << 53)

    def normal(position: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log(uniform(position, 1)))
        return scale * radius * F.cos(2.0 * F.pi() * uniform(position, 2))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), normal)
