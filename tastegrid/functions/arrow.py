"""Arrow columns to NumPy arrays and back, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A column of equally long number lists as a 2-d array."""
    flat = flattened(column)
    values = flat.to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1 if len(column) and len(flat) else 0)


def flattened(column: pa.ChunkedArray) -> pa.Array:
    """All list entries of a column in row order."""
    whole = column.combine_chunks()
    return whole.flatten()


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def places(values, keys: pa.Array) -> np.ndarray:
    """Position of each value among the keys, -1 where it is none of them."""
    found = pc.index_in(values, value_set=keys)
    return pc.fill_null(found, -1).to_numpy().astype(np.int64)


def lists(values: np.ndarray, dtype=np.float64) -> pa.Array:
    """Rows of a 2-d array as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    kind = pa.list_(pa.field("element", pa.from_numpy_dtype(dtype)))
    flat = pa.array(np.ascontiguousarray(values, dtype=dtype).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(offsets), flat, type=kind)
