"""Byte-level BPE over whole texts by prefix dynamic programming.

A text is parted by a pattern, and each part is encoded by itself. The merges
of a part end in exactly one row of tokens, and so do those of each of its byte
prefixes, where the row of a prefix is its last token after the row of what is
before. So the last token of each prefix tells all: it is the one token that
ends the prefix and stays apart from the last token before it. Two tokens stay
apart if no merge over their border comes before the merges that make them.

A table of last tokens grows by appending bytes, with nothing done again. After
an edit it is computed from there until it agrees with the old table for the
length of the longest token, since then the rest stays as it was.

Vocabularies of ranks are as the tiktoken library reads them: the merge with
the smallest rank comes first, of equal ones the leftmost, and a part that is
itself a token is that token. Parts that a text shares with others of a batch
are encoded once, and a worker keeps a bounded number of them.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import add_columns
from tastegrid.llm.segments import Strings, begins, cut_places, part_places, ranges, segments

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct parts whose ids a worker keeps at least; it drops what it didn't use since it took in as many.
KNOWN_PARTS = 250_000
#: Pairs of tokens of which a worker keeps whether they stay apart.
KNOWN_PAIRS = 1_000_000
#: Longer parts are not kept.
_LONG = 256
_NEVER = 1 << 60


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ranks of tokens and the two parts that each token is merged from."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made = {token: rank for token, rank in ranks.items() if self._split(token, rank)}
        #: Bytes of the longest token by its last four bytes; others have three at most.
        self.reach: dict[bytes, int] = {}
        for token in self.made:
            if len(token) > 3:
                self.reach[token[-4:]] = max(self.reach.get(token[-4:], 0), len(token))
        self.known: dict[int, bool] = {}

    def _split(self, token: bytes, rank: int) -> bool:
        """Note the last merge of a token; false if merges don't lead to it."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            joins = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            least = min(joins)
            if least == _NEVER:
                return False
            at = joins.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            self.left[rank], self.right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
        return True

    def _spine(self, token: int, side: dict[int, int]) -> list[int]:
        found = [token]
        while token in side:
            token = side[token]
            found.append(token)
        return found[::-1]

    def apart(self, first: int, second: int) -> bool:
        """Whether the merges of the two tokens' bytes end in these two tokens."""
        if len(self.known) >= KNOWN_PAIRS:
            self.known.clear()
        found = self.known[first << 32 | second] = self._stay(first, second)
        return found

    def _stay(self, first: int, second: int) -> bool:
        ends, starts = self._spine(first, self.right), self._spine(second, self.left)
        i = j = 0
        while True:
            over = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]], _NEVER)
            next_left = ends[i + 1] if i + 1 < len(ends) else _NEVER
            next_right = starts[j + 1] if j + 1 < len(starts) else _NEVER
            if over < next_left and over <= next_right and over < _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of every prefix of a part."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> "PrefixTable":
        """Go on behind the end."""
        done, self.data = len(self.data), self.data + more
        self._fill(done + 1, len(self.data) + 1)
        return self

    def become(self, data: bytes) -> "PrefixTable":
        """The table of other bytes, kept as far as they begin alike."""
        same = 0
        for one, other in zip(data, self.data):
            if one != other:
                break
            same += 1
        self.data, self.last = self.data[:same], self.last[:same]
        return self.append(data[same:])

    def _fill(self, first: int, beyond: int) -> None:
        """The last tokens of the prefixes of first to beyond - 1 bytes."""
        data, last, words = self.data, self.last, self.vocabulary
        token_of, reach, known = words.made.get, words.reach.get, words.known.get
        for end in range(first, beyond):
            start = end - reach(data[end - 4 : end], 3)
            for start in range(start if start > 0 else 0, end):
                token = token_of(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    break
                stay = known(last[start - 1] << 32 | token)
                if stay or (stay is None and words.apart(last[start - 1], token)):
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for the bytes from start to end; returns how many prefixes were computed."""
        old, tail = self.last, self.data[end:]
        self.data, self.last = self.data[:start] + new + tail, old[:start]
        same, shift = 0, len(new) - (end - start)
        settled = start + len(new)
        for place in range(start + 1, len(self.data) + 1):
            self._fill(place, place + 1)
            token = self.last[-1]
            if place > settled:
                # tokens that reach back over the edit are other ones even if they are equal
                inside = place - len(self.vocabulary.tokens[token]) >= settled
                same = same + 1 if inside and token == old[place - shift - 1] else 0
                if same == self.vocabulary.longest:
                    self.last += old[place - shift :]
                    return place - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


def _ranges_of(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    array = np.array(points)
    starts = array[np.append(True, np.diff(array) > 1)]
    ends = array[np.append(np.diff(array) > 1, True)]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts.tolist(), ends.tolist()))


class PartCutter:
    """Parts of texts by the pattern.

    Python's and the tiktoken library's tables of characters are of different
    ages. So characters that the older of Python's tables doesn't know are read
    as the library does: each is cut as a stand-in of the class that it has there.
    """

    def __init__(self, pattern: str) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
        self.unknown = regex.compile(f"[{_ranges_of(unknown)}]")
        #: All characters below U+0300 are known.
        self.common = re.compile("[\\u0000-\\u02ff]*").fullmatch
        single = {bytes([k]): k for k in range(256)}
        self.probes = [
            (tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={}), stand_in)
            for kind, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))
        ]

    def _stand_in(self, found) -> str:
        for probe, stand_in in self.probes:
            if probe.encode_ordinary(found[0]):
                return stand_in
        return "#"

    def parts(self, text: str) -> list[str]:
        if self.common(text) or not self.unknown.search(text):
            return self.pattern.findall(text)
        # a stand-in has one place in the text as well, and no ending after an apostrophe is one of it
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.unknown.sub(self._stand_in, text))]


class Coder:
    """Ids of whole batches of texts and the bytes of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as source:
            pairs = (line.split() for line in source if line.strip())
            self.vocabulary = Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs})
        self.cutter = PartCutter(pattern)
        self.strings = Strings(self.vocabulary.tokens)
        self.known: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    def _learn(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of pieces of texts; parts in order share the tables of their common beginnings."""
        made_of = {piece: [part.encode() for part in self.cutter.parts(piece.decode())] for piece in pieces}
        ids: dict[bytes, list[int]] = {}
        table = PrefixTable(self.vocabulary)
        for part in sorted({part for parts in made_of.values() for part in parts}):
            whole = self.vocabulary.ranks.get(part)
            ids[part] = table.become(part).ids() if whole is None else [whole]
        return {
            piece: ids[parts[0]] if len(parts) == 1 else [one for part in parts for one in ids[part]]
            for piece, parts in made_of.items()
        }

    def piece_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of some distinct pieces of texts."""
        found = [self.known.get(piece) or self.older.get(piece) for piece in pieces]
        new = self._learn([piece for piece, ids in zip(pieces, found) if ids is None])
        if len(self.known) >= KNOWN_PARTS:
            self.known, self.older = {}, self.known
        for place, piece in enumerate(pieces):
            ids = found[place]
            if ids is None:
                ids = found[place] = new[piece]
            if len(piece) <= _LONG:
                self.known[piece] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        cut = segments(texts, part_places)
        own = self.piece_ids(cut.distinct)
        starts = begins(np.fromiter(map(len, own), np.int64, len(own)))
        flat = np.fromiter(chain.from_iterable(own), np.int32, starts[-1])
        used = np.diff(starts)[cut.which]
        return flat[ranges(starts[cut.which], used)], begins(used)[cut.of]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids one after another, and where each row's begin."""
        data, starts = self.strings.joined(ids)
        return data, starts[bounds]

    def edited(self, text: str, ids: np.ndarray, start: int, end: int, new: str) -> tuple[str, np.ndarray]:
        """Text and ids after `new` is put for the characters from start to end.

        Only what lies between the nearest safe cuts around the edit is encoded
        again; the other ids stay. An append is an edit at the end.
        """
        start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
        end = max(start, end)
        changed = text[:start] + new + text[end:]
        data, other = text.encode(), changed.encode()
        head, tail = len(text[:start].encode()), len(text[end:].encode())
        old_cuts, new_cuts = _cuts(data), _cuts(other)
        both = new_cuts[new_cuts + 1 < head]
        left = int(both[-1]) if len(both) else 0
        # counted from the end, cuts behind the edit are cuts before and after it
        behind = len(other) - new_cuts[new_cuts > len(other) - tail]
        behind = behind[np.isin(behind, len(data) - old_cuts[old_cuts > len(data) - tail])]
        right = int(behind.max()) if len(behind) else 0
        through = begins(self.strings.sizes[ids])
        first, last = np.searchsorted(through, [left, len(data) - right])
        middle, _ = self.encode(pa.array([other[left : len(other) - right].decode()], pa.string()))
        return changed, np.concatenate([ids[:first], middle, ids[last:]])


def _cuts(data: bytes) -> np.ndarray:
    return cut_places(np.frombuffer(data, np.uint8))


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or ranks_path(), pattern or public_tokenizers.PATTERN
    return path, pattern


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers).cast(pa.binary())


def _lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded",
    path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """`docs` with the ids of each whole text and the bytes that these ids decode to.

    Null and empty texts have no ids and no bytes. Rows are looked at one by
    one, whatever their other columns hold; columns with the added names are
    replaced.
    """
    path, pattern = _settings(path, pattern)

    def coded(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        code = coder(path, pattern)
        flat, bounds = code.encode(arrays[0])
        return {ids: _lists(flat, bounds), decoded: _binary(*code.decode(flat, bounds))}

    return add_columns(docs, [text], coded, f"`{ids}` array<int>, `{decoded}` binary")


def decode(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """`encoded` with the bytes of its ids; null for null or unknown ids."""
    path, pattern = _settings(path, None)

    def bytes_of(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        code = coder(path, pattern)
        size = len(code.vocabulary.tokens)
        rows = [
            None if row is None or any(one is None or not 0 <= one < size for one in row)
            else b"".join(code.vocabulary.tokens[one] for one in row)
            for row in arrays[0].to_pylist()
        ]
        return {decoded: pa.array(rows, pa.binary())}

    return add_columns(encoded, [ids], bytes_of, f"`{decoded}` binary")


def edit(
    encoded: DataFrame, text: str = "text", ids: str = "ids", start: str = "start", end: str = "end",
    new: str = "new", path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """`encoded` with text and ids after one edit per row, encoded again near it only.

    The characters from `start` (null: the end) to `end` (null: as `start`) are
    replaced by `new` (null: nothing); places beyond the text are its end. Null
    texts are empty ones.
    """
    path, pattern = _settings(path, pattern)

    def changed(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        code, found = coder(path, pattern), []
        for own, held, first, last, put in zip(*(array.to_pylist() for array in arrays)):
            own = own or ""
            first = len(own) if first is None else first
            found.append(code.edited(own, np.array(held or [], np.int32), first, first if last is None else last, put or ""))
        flat = np.concatenate([np.zeros(0, np.int32), *(held for _, held in found)])
        sizes = np.array([len(held) for _, held in found], np.int64)
        return {text: pa.array([own for own, _ in found], pa.string()), ids: _lists(flat, begins(sizes))}

    order = encoded.columns
    done = add_columns(encoded, [text, ids, start, end, new], changed, f"`{text}` string, `{ids}` array<int>")
    return done.select(*(F.col("`" + name.replace("`", "``") + "`") for name in order))


def digests(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The key, the number of ids, and the sha256 of the decimal ids and of the decoded bytes."""
    decimal = F.array_join(F.col(ids).cast("array<string>"), ",")
    return encoded.select(
        F.col(key), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
