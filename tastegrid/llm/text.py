"""Words and hashes of whole Arrow batches of text in NumPy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240607)
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(_BASE_INVERSE)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """Words of a batch: `begin` and `end` count bytes, words of text i are of[i]:of[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    of: np.ndarray
    code: np.ndarray


def words(
    texts: pa.Array, parting: np.ndarray = SPACES, folded: np.ndarray = LOWER,
    cuts: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Words:
    """Cut texts at bytes in `parting`; code is a 64-bit hash of the folded word.

    `cuts` may name more places, found in the bytes, before which words end.
    """
    data, offsets = raw(texts)
    inside = ~parting[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    if cuts is not None and len(data):
        starts_text[cuts(data)] = True
    begin = np.flatnonzero(inside & (~before[:-1] | starts_text[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    end = np.flatnonzero(inside & (~after[1:] | starts_text[1:])) + 1
    up, down = _powers(max(1 << 19, 1 << int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[folded[data]] * up[: len(data)], out=sums[1:])
        code = mixed((sums[end] - sums[begin]) * down[begin])
    return Words(data, offsets, begin, end, np.searchsorted(begin, offsets), code)


def runs(code: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every `length` consecutive word codes."""
    count = len(code) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(length), np.uint64)
    with np.errstate(over="ignore"):
        for place in range(length):
            total += code[place : place + count] * _STEPS[place % 64] ^ np.uint64(place // 64)
    return mixed(total)


def shingles(code: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text; short texts are one shingle."""
    if not len(code):
        return np.zeros(0, np.uint64)
    return np.unique(runs(code, min(length, len(code))))
