"""Alignment of the tokens of two tokenizers over a corpus.

Both tokenizers cut a space and a text into tokens. Places where tokens of both
end cut these into groups; a link is a pair of tokens, one of each, whose bytes
overlap. Texts are shuffled whole, so that equal ones are one row with their
number; each distinct text is tokenised and aligned once. The documents that
hold a pair of ids are counted from the distinct texts' pairs, each text
weighing as many documents as have it, and the measures go back to the
documents by a 128-bit hash of the text. The texts that more than one in
`HOT_SHARE` documents have are few enough to be broadcast, so no task gets all
copies of one.

Within a batch, a segment that occurs in several texts goes through the
tokenizers once: both always part a text at a safe cut.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import materialize, pieces, temporary
from tastegrid.llm.segments import Strings, begins, ranges, segments
from tastegrid.session import materialize as keep

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
#: One in so many documents makes a text a hot one, so there are at most as many hot texts.
HOT_SHARE = 1024
#: Counted pairs that are broadcast; with more, the texts' pairs are shuffled to them.
BROADCAST_PAIRS = 1_000_000
_BATCH_BYTES = 1 << 20
_LINKS = "links array<struct<pair: bigint, uses: int>>"
_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevel:
    """Ids of a byte-level tokenizer; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # other bytes are written as the characters from U+0100 on, in order
        others = [byte for byte in range(256) if byte not in printed]
        byte_of = {chr(byte): byte for byte in printed} | {chr(256 + k): byte for k, byte in enumerate(others)}
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.tokens = [
            bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [one.ids for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids of a piece tokenizer, which puts a space before the text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        #: Whether no piece reaches over the beginning of a word.
        self.parted = not any("▁" in name.lstrip("▁") for name in names)
        self.tokens = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode()
            for k, name in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([text[1:] for text in texts], num_threads=1)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = begins(np.fromiter(map(len, rows), np.int64, len(rows)))
    return np.fromiter(chain.from_iterable(rows), np.int64, bounds[-1]), bounds


class Side:
    """One tokenizer's ids of some pieces of text, as flat arrays."""

    def __init__(self, code: ByteLevel | Pieces, strings: Strings, texts: list[str], data: list[bytes]) -> None:
        self.ids, self.bounds = _flat(code.encode(texts))
        joined, starts = strings.joined(self.ids)
        made, joined = starts[self.bounds].tolist(), joined.tobytes()
        self.right = np.array([joined[a:b] == own for a, b, own in zip(made, made[1:], data)], bool)
        self.strings = strings

    def keep(self, good: np.ndarray) -> None:
        """Leave the ids of the pieces that aren't good out."""
        sizes = np.where(good, np.diff(self.bounds), 0)
        self.ids = self.ids[ranges(self.bounds[:-1], sizes)]
        self.bounds = begins(sizes)
        self.ends = np.cumsum(self.strings.sizes[self.ids])
        self.starts = self.ends - self.strings.sizes[self.ids]


class Aligner:
    """Groups and links of batches of texts."""

    def __init__(self, first: str, second: str) -> None:
        self.first, self.second = ByteLevel(first), Pieces(second)
        self.bytes = Strings(self.first.tokens), Strings(self.second.tokens)
        self.decimals = Strings([str(k).encode() + b" " for k in range(max(len(self.first.tokens), len(self.second.tokens)))])
        self.n_second = len(self.second.tokens)

    def align(self, spaced: pa.Array) -> dict[str, pa.Array]:
        """Measures and linked pairs of texts that each have a space put before.

        A text whose tokens' bytes differ from it has no tokens.
        """
        cut = segments(spaced) if self.second.parted else segments(spaced, lambda data: np.zeros(0, np.int64))
        texts = [one.decode() for one in cut.distinct]
        a, b = (
            Side(code, strings, texts, cut.distinct)
            for code, strings in zip((self.first, self.second), self.bytes)
        )
        good = a.right & b.right
        a.keep(good)
        b.keep(good)
        common = np.intersect1d(a.ends, b.ends, assume_unique=True)
        group_a, group_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
        # the last token of each piece ends where a token of the other does
        n_a, n_b = np.diff(a.bounds), np.diff(b.bounds)
        last = np.append(group_a, -1)[np.maximum(a.bounds[1:], 1) - 1]
        groups = np.diff(np.maximum.accumulate(np.append(-1, np.where(n_a > 0, last, -1))))
        low = np.searchsorted(b.ends, a.starts, "right")
        links = np.searchsorted(b.starts, a.ends, "left") - low
        pair = np.repeat(a.ids, links) * self.n_second + b.ids[ranges(low, links)]
        through = begins(links)
        n_links = np.diff(through[a.bounds])

        rows = len(spaced)
        of = np.repeat(np.arange(rows), np.diff(cut.of))
        bad = np.bincount(of[~good[cut.which]], minlength=rows) > 0
        which, of = cut.which[~bad[of]], of[~bad[of]]

        def total(of_piece: np.ndarray) -> pa.Array:
            return pa.array(np.bincount(of, of_piece[which], minlength=rows).astype(np.int64))

        line, at = self._written(a, b, group_a, group_b)
        sizes = np.diff(at)[which]
        written = line[ranges(at[which], sizes)].tobytes()
        ends = begins(np.bincount(of, sizes, minlength=rows).astype(np.int64)).tolist()
        sums = [hashlib.sha256(written[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
        # pairs of each text, equal ones as one
        used = n_links[which]
        held = pair[ranges(through[a.bounds[:-1]][which], used)]
        owner = np.repeat(of, used)
        order = np.lexsort((held, owner))
        held, owner = held[order], owner[order]
        new = np.flatnonzero(np.append(True, (np.diff(held) != 0) | (np.diff(owner) != 0))[: len(held)])
        structs = pa.StructArray.from_arrays(
            [pa.array(held[new], pa.int64()), pa.array(np.diff(np.append(new, len(held))), pa.int32())], ["pair", "uses"]
        )
        offsets = begins(np.bincount(owner[new], minlength=rows))
        return {
            "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(groups), "n_links": total(n_links),
            "groups_sha256": pa.array(sums, pa.string()),
            "links": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
        }

    def _written(self, a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, each ended by a semicolon, and where each piece's begin."""
        group = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([a.ids, b.ids])[order]
        line, at = self.decimals.joined(ids)
        ends = np.append(group[1:] != group[:-1], True)[: len(group)]
        line[at[1:] - 1] = np.where(ends, np.where(group % 2 == 0, ord("|"), ord(";")), ord(","))
        return line, at[a.bounds + b.bounds]


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(first, second)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of text and n, how many rows of `docs` have it; null and empty texts are left out."""
    return docs.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))


def aligned_texts(texts: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of text_code, n, the measures and the linked pairs of each distinct text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = aligner(first, second)
        for batch in batches:
            for piece in pieces(batch, ["text"], _BATCH_BYTES):
                found = code.align(pc.binary_join_element_wise("", piece.column("text"), " "))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("text_code"), piece.column("n"), *found.values()], ["text_code", "n", *found]
                )

    rows = texts.select("text", "n", text_code("text").alias("text_code"))
    return rows.mapInArrow(run, f"text_code binary, n long, {_MEASURES}, {_LINKS}")


def text_code(name: str) -> Column:
    """A 128-bit hash of a text; null for null and empty ones."""
    return F.when(F.col(name) != "", F.unhex(F.md5(F.col(name))))


def pair_counts(aligned: DataFrame, n_second: int) -> DataFrame:
    """Rows of pair, n_docs and best, whether no other pair of its first id has more."""
    counts = aligned.select("n", F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {n_second}")))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return materialize(counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None,
) -> DataFrame:
    """Rows of doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one per row of `docs`.

    n_best counts the links whose pair of ids is in as many documents as any
    pair of its first id; count_sum adds up the documents of each link's pair.
    Texts that are null or empty, or that the tokens of a tokenizer don't give
    back, have no tokens: zeros and an empty string. Rows that repeat an id, or
    have none, are rows of their own, and each counts as a document.
    """
    paths = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with temporary(docs.sparkSession):
        aligned = materialize(aligned_texts(distinct_texts(rows), *paths))
        n_second = len(aligner(*paths).second.tokens)
        measured = keep(_measured(aligned, n_second))
    return _to_documents(rows, measured)


def _measured(aligned: DataFrame, n_second: int) -> DataFrame:
    """The distinct texts with the sums over their links."""
    counts = pair_counts(aligned, n_second)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select("text_code", F.inline("links"))
    sums = links.join(counts, "pair").groupBy("text_code").agg(
        F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("uses") * F.col("n_docs")).alias("count_sum"),
    )
    return aligned.drop("links").join(sums, "text_code", "left")


def _to_documents(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Measures by document; copies of hot texts stay where they are."""
    total = measured.agg(F.sum("n")).first()[0] or 0
    hot = measured.where(F.col("n") > total / HOT_SHARE)
    hot_codes = F.broadcast(hot.select("text_code").withColumn("hot", F.lit(True)))
    coded = rows.select("doc_id", text_code("text").alias("text_code")).join(hot_codes, "text_code", "left")
    some = coded.where("hot").join(F.broadcast(hot), "text_code")
    rest = coded.where("hot IS NULL")
    # rows without a text are told apart, so that they are no hot key
    known = rest.where("text_code IS NOT NULL").join(measured.where(F.col("n") <= total / HOT_SHARE), "text_code")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    none = rest.where("text_code IS NULL").select(
        "doc_id", *(F.lit(0).cast("long").alias(name) for name in names), F.lit("").alias("groups_sha256")
    )
    found = some.select(*known.columns).unionByName(known)
    zero = (F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in names)
    return found.select("doc_id", *zero, "groups_sha256").unionByName(none)
