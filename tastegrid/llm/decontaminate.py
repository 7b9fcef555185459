"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contaminated by a document that holds at least `threshold` of
its distinct five-word shingles. Documents are far longer than items, so the
Jaccard similarity of the two says little, and bands of equal MinHash values
would miss most leaks. The search is therefore one-sided: items are parted by
the size of their shingle sets, and the items of a part keep as sketch the
smallest MinHash values, one more than shingles may be missing at the part's
largest size. A document that holds enough of an item holds one of its sketch
values for certain, so candidates are complete at any length; they are then
checked shingle by shingle on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import add_columns, columns_of, pieces
from tastegrid.llm.text import Words, runs, words

WORDS = 5
THRESHOLD = 0.8
#: Characters of items that one pass over the documents searches for.
BLOCK_CHARS = 8 << 20

#: ASCII letters and digits and all other characters make up words.
_PARTING = np.ones(256, bool)
_PARTING[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = False


@dataclass
class ItemIndex:
    """Sketch values of a block of items and the items' shingles."""

    ids: list[int]
    shingles: list[set[bytes]]
    codes: list[np.ndarray]
    sketch: np.ndarray
    owner: np.ndarray
    maybe: np.ndarray


def _cut(texts: pa.Array) -> Words:
    return words(pc.utf8_lower(texts.cast(pa.large_string())), _PARTING)


def _text(cut: Words, first: int, last: int) -> bytes:
    return b" ".join(cut.data[cut.begin[k] : cut.end[k]].tobytes() for k in range(first, last))


def _runs(cut: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle codes, their first words and texts, in order; short texts are one shingle."""
    sizes = np.diff(cut.of)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    code = runs(cut.code, length)
    whole = np.flatnonzero(owner[: len(code)] == owner[length - 1 : length - 1 + len(code)])
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    extra = [runs(cut.code[cut.of[k] : cut.of[k + 1]], int(sizes[k]))[0] for k in short]
    code = np.append(code[whole], np.array(extra, np.uint64))
    first, owner = np.append(whole, cut.of[short]), np.append(owner[whole], short)
    order = np.argsort(first, kind="stable")
    return code[order], first[order], owner[order]


def _missing(size: int, threshold: float) -> int:
    """How many of `size` shingles a match may lack."""
    return size - math.ceil(threshold * size - 1e-9)


def build_index(
    ids: list[int], texts: list[str | None], length: int = WORDS, threshold: float = THRESHOLD
) -> ItemIndex:
    cut = _cut(pa.array(texts, pa.large_string()))
    code, first, owner = _runs(cut, length)
    found, codes, values, owners = [], [], [], []
    for item in range(len(ids)):
        own = np.flatnonzero(owner == item)
        stop = cut.of[item + 1]
        found.append({_text(cut, first[k], min(first[k] + length, stop)) for k in own})
        codes.append(np.unique(code[own]))
        if len(codes[-1]):
            largest = 1 << (len(codes[-1]) - 1).bit_length()  # of its part: sizes in (largest / 2, largest]
            kept = codes[-1][: _missing(largest, threshold) + 1]
            values.append(kept)
            owners.append(np.full(len(kept), item))
    sketch = np.concatenate([np.zeros(0, np.uint64), *values])
    owners = np.concatenate([np.zeros(0, np.int64), *owners])
    order = np.argsort(sketch, kind="stable")
    maybe = np.zeros(1 << 20, bool)
    maybe[(sketch & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return ItemIndex(ids, found, codes, sketch[order], owners[order], maybe)


def search(
    index: ItemIndex, texts: pa.Array, length: int = WORDS, threshold: float = THRESHOLD
) -> list[tuple[int, int, int]]:
    """Row of `texts`, item and shared shingles of each match."""
    cut = _cut(texts)
    code, first, owner = _runs(cut, length)
    hits = np.flatnonzero(index.maybe[(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
    left = np.searchsorted(index.sketch, code[hits])
    right = np.searchsorted(index.sketch, code[hits], "right")
    pairs = set()
    for hit, low, high in zip(hits[right > left], left[right > left], right[right > left]):
        pairs.update((int(owner[hit]), int(item)) for item in index.owner[low:high])
    matches = []
    for row, item in sorted(pairs):
        own = np.arange(*np.searchsorted(owner, (row, row + 1)))
        shared = own[np.isin(code[own], index.codes[item])]
        stop = cut.of[row + 1]
        same = {_text(cut, first[k], min(first[k] + length, stop)) for k in shared}
        count = len(same & index.shingles[item])
        if count >= len(index.shingles[item]) - _missing(len(index.shingles[item]), threshold):
            matches.append((row, item, count))
    return matches


def _blocks(items: DataFrame, length: int, threshold: float) -> Iterator[ItemIndex]:
    """Indexes over blocks of items of bounded size, one block in memory at a time."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    count = -(-chars // BLOCK_CHARS)
    for number in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        rows = sorted(block.collect(), key=lambda row: (row[0] is None, row[0] or 0, row[1]))
        yield build_index([row[0] for row in rows], [row[1] for row in rows], length, threshold)


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", length: int = WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """Rows of doc_id, item_id, n_shared, n_item and containment, one per match.

    Letters are compared in lower case, punctuation parts words. Texts with
    fewer words than `length` are one shingle, so a short item matches only a
    document that is the same word for word; null and empty texts match
    nothing. Repeated documents match once per row, repeated items once. Large
    item tables are searched in blocks, one pass over the documents each.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_shared int, n_item int, containment double"
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], schema)
    for index in _blocks(items, length, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, ["text"]):
                    known = shared.value
                    matches = search(known, piece.column("text"), length, threshold)
                    rows, places, counts = zip(*matches) if matches else ((), (), ())
                    sizes = [len(known.shingles[place]) for place in places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id").take(pa.array(rows, pa.int64())),
                            pa.array([known.ids[place] for place in places], pa.int64()),
                            pa.array(counts, pa.int32()),
                            pa.array(sizes, pa.int32()),
                            pa.array([a / b for a, b in zip(counts, sizes)], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        found = found.unionByName(frame.mapInArrow(run, schema))
    return found


def drop_leaked(docs: DataFrame, items: DataFrame, length: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that contaminate an item; columns stay as they are."""
    columns = columns_of(docs)
    for index in _blocks(items, length, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def mark(arrays: list[pa.Array], shared=shared) -> dict[str, pa.Array]:
            marks = np.zeros(len(arrays[0]), bool)
            marks[[row for row, _, _ in search(shared.value, arrays[0], length, threshold)]] = True
            return {"__leaked": pa.array(marks)}

        docs = add_columns(docs, ["text"], mark, "__leaked boolean").where("NOT __leaked").select(*columns)
    return docs


LEAKS_SQL = r"""
WITH cut AS (
  SELECT kind, id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 1, item_id, text FROM benchmark)
), starts AS (
  SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM cut WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT kind, id, array_to_string(w[k:k + 4], ' ') AS s FROM starts
), item AS (SELECT id, count(*) AS n FROM shingle WHERE kind = 1 GROUP BY id),
pair AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingle d JOIN shingle i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY d.id, i.id
)
SELECT doc_id, item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_item,
       n_shared / n AS containment
FROM pair JOIN item ON item.id = item_id WHERE 5 * n_shared >= 4 * n
"""
