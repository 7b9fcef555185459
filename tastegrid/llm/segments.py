"""Distinct stretches of text between safe cuts, for tokenizers that part words at spaces.

A cut lies before a single space with a printable character other than a space
on either side. Pre-tokenizers that attach a space to the word behind it, and
piece vocabularies without a space inside a piece, always part a text there, so
ids of a text are the ids of its segments one after another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tastegrid.llm.text import Words, words

_NOTHING = np.zeros(256, bool)
_SAME = np.arange(256, dtype=np.uint8)
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_PRINTED[0x80:] = True
#: First bytes of the characters of several bytes among which are white space and U+2581.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@dataclass
class Segments:
    """Distinct segments, and which of them each text is made of.

    Text i is made of segments which[of[i]:of[i + 1]].
    """

    distinct: list[bytes]
    which: np.ndarray
    of: np.ndarray


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places of the spaces before which UTF-8 bytes are cut."""
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & (space < len(data) - 1)]
    before, after = data[space - 1], data[space + 1]
    good = _PRINTED[before] & _PRINTED[after] & ~_MAYBE_SPACE[after]
    good &= ~((before >= 0x80) & (_MAYBE_SPACE[data[space - 2]] | _MAYBE_SPACE[data[np.maximum(space - 3, 0)]]))
    return space[good]


_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 mark, 3 other
_KIND[0x21:0x7F] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1


def part_places(data: np.ndarray) -> np.ndarray:
    """Safe cuts, and places between letters, digits and marks of ASCII or Latin 1.

    A letter behind an apostrophe isn't cut off.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 0
    left, right = kind[:-1], kind[1:]
    ends = (left < 3) & (right < 3) & (left != right) & ~((data[:-1] == 0x27) & (right == 0))
    return np.append(cut_places(data), np.flatnonzero(ends) + 1)


def segments(texts: pa.Array, places: Callable[[np.ndarray], np.ndarray] = cut_places) -> Segments:
    """The segments of a batch; null texts have none. Equal ones are told by a 64-bit hash."""
    cut: Words = words(texts, _NOTHING, _SAME, places)
    _, first, which = np.unique(cut.code, return_index=True, return_inverse=True)
    data = cut.data.tobytes()
    return Segments([data[a:b] for a, b in zip(cut.begin[first].tolist(), cut.end[first].tolist())], which, cut.of)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    through = np.cumsum(sizes)
    return np.repeat(starts - (through - sizes), sizes) + np.arange(through[-1] if len(through) else 0)


def begins(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive ranges begins, and the end of the last."""
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


class Strings:
    """Byte strings by number, joined for whole arrays of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all strings one after another, and where each begins."""
        sizes = self.sizes[numbers]
        return self.data[ranges(self.starts[numbers], sizes)], begins(sizes)
