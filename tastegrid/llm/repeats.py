"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes, counted in words, those are kept that begin with the least
hashed word run of some window. Every passage of the wanted length holds a
whole window, and equal windows keep equal places, so each repeat of that
length shares a kept suffix. Kept suffixes are dealt out by their first words
and sorted by what follows, then by what precedes. In this order a suffix's
neighbours from other documents share most words with it to the right, in the
order of what precedes most to the left. Matches are extended to both sides as
far as a repeat of the wanted length can need, and stretches of that length are
reported. Longer repeats hold several kept suffixes, whose stretches are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.frames import few, materialize, pieces, release, temporary
from tastegrid.llm.text import mixed, runs, words
from tastegrid.session import materialize as keep

MIN_WORDS = 50
HEAD = 8
#: Suffixes with equal heads that one task sorts; with more, the passages around the head are grouped.
GROUP = 20_000
_PLACE_BITS = 26


def window_places(code: np.ndarray, of: np.ndarray, head: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head codes at all words, the words at which windows inside a text begin, and the word whose suffix each keeps.

    A window holds least - head + 1 heads; of equal smallest ones the first counts.
    """
    heads = runs(code, head)
    window = least - head + 1
    count = len(code) - least + 1
    if count <= 0:
        return heads, np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    value = (heads & ~mask) | (np.arange(len(heads), dtype=np.uint64) & mask)
    low, width = value, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:count], low[window - width : window - width + count])
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    inside = owner[:count] == owner[least - 1 : least - 1 + count]
    return heads, np.flatnonzero(inside), (low[inside] & mask).astype(np.int64)


def kept_places(code: np.ndarray, of: np.ndarray, head: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Head codes at all words, and the words at which suffixes are kept."""
    heads, _, places = window_places(code, of, head, least)
    return heads, np.unique(places)


def _text_code(code: np.ndarray) -> int:
    weights = mixed(np.arange(1, len(code) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        total = (code * (weights | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(code))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _suffixes(docs: DataFrame, head: int, least: int) -> DataFrame:
    """Rows of doc_id, n_words, text_code, heads and places for texts that are long enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                cut = words(piece.column("text"))
                heads, places = kept_places(cut.code, cut.of, head, least)
                sizes = np.diff(cut.of)
                rows = np.flatnonzero(sizes >= least)
                bounds = np.searchsorted(places, cut.of)
                spans = [slice(bounds[row], bounds[row + 1]) for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32)),
                        pa.array([_text_code(cut.code[cut.of[row] : cut.of[row + 1]]) for row in rows], pa.int64()),
                        pa.array([heads[places[span]].view(np.int64) for span in spans], pa.list_(pa.int64())),
                        pa.array([(places[span] - cut.of[row]).astype(np.int32) for span, row in zip(spans, rows)], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_words", "text_code", "heads", "places"],
                )

    schema = "doc_id long, n_words int, text_code long, heads array<long>, places array<int>"
    return docs.mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, head: int, least: int) -> DataFrame:
    """A row per wanted suffix with the codes of the words after and before its head."""
    reach = least - head

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                cut = words(piece.column("text"))
                small = (cut.code >> np.uint64(32)).astype("<u4")
                columns: list[list] = [[], [], [], [], []]
                lists = [piece.column(name).to_pylist() for name in ("doc_id", "text_code", "suffixes")]
                for row, (doc, code, suffixes) in enumerate(zip(*lists)):
                    first, last = cut.of[row], cut.of[row + 1]
                    if _text_code(cut.code[first:last]) != code:
                        continue  # another text under the same id
                    own = small[first:last]
                    back = own[::-1]
                    for suffix in suffixes:
                        place = suffix["place"]
                        after = own[place + head : place + head + reach].tobytes()
                        before = back[len(own) - place : len(own) - place + reach].tobytes()
                        for column, value in zip(columns, (suffix["head"], doc, place, after, before)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                    ["head", "doc_id", "place", "after", "before"],
                )

    joined = docs.join(wanted, "doc_id").select("doc_id", "text", "text_code", "suffixes")
    return joined.mapInArrow(run, "head long, doc_id long, place int, after binary, before binary")


def _windows(docs: DataFrame, hot: np.ndarray, head: int, least: int) -> DataFrame:
    """Rows of code, doc_id and start_word for the windows whose kept suffix begins with a head in `hot`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                cut = words(piece.column("text"))
                heads, starts, places = window_places(cut.code, cut.of, head, least)
                starts = starts[np.isin(heads[places].view(np.int64), hot)]
                row = np.searchsorted(cut.of, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs(cut.code, least)[starts].view(np.int64)), piece.column("doc_id").take(pa.array(row)),
                        pa.array((starts - cut.of[row]).astype(np.int32)),
                    ],
                    ["code", "doc_id", "start_word"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "code long, doc_id long, start_word int")


def _hot_matches(windows: DataFrame, least: int) -> DataFrame:
    """The windows that other documents hold too, one stretch each."""
    met = windows.groupBy("code").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    met = materialize(met)  # so that the join can split a window that very many documents hold
    other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return windows.join(met, "code").select(
        "doc_id", "start_word", (F.col("start_word") + least).alias("end_word"), other.alias("match_doc_id")
    )


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of each row, filled up with zeros, and their numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
    sizes = np.diff(offsets) // 4
    table = np.zeros((len(column), width), "<u4")
    held = np.arange(width) < sizes[:, None]
    table[held] = flat[offsets[0] // 4 : offsets[-1] // 4]
    return table, sizes


def _common(table: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = table[a] != table[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def _order_by(group: np.ndarray, table: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Order of rows by group, then the row of `table`, then document."""
    keys = np.hstack(
        [group.astype(">u4")[:, None].view(np.uint8), np.ascontiguousarray(table).view(np.uint8), docs.astype(">u8")[:, None].view(np.uint8)]
    )
    keys = np.ascontiguousarray(keys)
    return np.argsort(keys.view(f"V{keys.shape[1]}").ravel(), kind="stable")


def _other_neighbors(group: np.ndarray, docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with the next row of another document before, and after, in sorted groups."""
    count = len(group)
    every = np.arange(count)
    new_run = np.ones(count, bool)
    new_run[1:] = (group[1:] != group[:-1]) | (docs[1:] != docs[:-1])
    run = np.cumsum(new_run) - 1
    starts = np.flatnonzero(new_run)
    stops = np.append(starts[1:], count)
    pairs = []
    for other in (starts[run] - 1, stops[run]):
        fine = (other >= 0) & (other < count)
        rows, other = every[fine], other[fine]
        same = group[rows] == group[other]
        pairs.append((rows[same], other[same]))
    return pairs


def neighbor_matches(block: pa.RecordBatch, head: int, least: int) -> pa.RecordBatch:
    """Stretches of at least `least` words around each suffix that other documents hold.

    `block` holds whole groups sorted by what follows the head. The neighbours
    in this order share most words to the right, those in the order of what
    precedes share most to the left; both are extended to both sides. Where
    these stretches leave room for a longer one that neither neighbour holds,
    the passages of `least` words around the head are compared as such.
    """
    reach, count = least - head, block.num_rows
    docs, place = block.column("doc_id").to_numpy(), block.column("place").to_numpy().astype(np.int64)
    heads = block.column("head").to_numpy()
    after, n_after = _matrix(block.column("after"), reach)
    before, n_before = _matrix(block.column("before"), reach)
    group = np.zeros(count, np.int64)
    group[1:] = np.cumsum(heads[1:] != heads[:-1])
    most_right, most_left = np.full(count, -1), np.full(count, -1)
    held_right, held_left = np.full(count, -1), np.full(count, -1)
    found: list[np.ndarray] = []

    def add(rows: np.ndarray, left: np.ndarray, right: np.ndarray, other: np.ndarray) -> None:
        found.append(np.column_stack([docs[rows], place[rows] - left, place[rows] + head + right, other]))

    for order in (np.arange(count), _order_by(group, before, docs)):
        for rows, other in _other_neighbors(group[order], docs[order]):
            rows, other = order[rows], order[other]
            right, left = _common(after, n_after, rows, other), _common(before, n_before, rows, other)
            np.maximum.at(most_right, rows, right)
            np.maximum.at(most_left, rows, left)
            long = right + left + head >= least
            rows, other, right, left = rows[long], other[long], right[long], left[long]
            np.maximum.at(held_right, rows, right)
            np.maximum.at(held_left, rows, left)
            add(rows, left, right, docs[other])
    able = most_right + most_left + head >= least
    short = able & ((held_right < most_right) | (held_left < most_left))
    rows = np.flatnonzero(able & np.isin(group, group[short]))
    if len(rows):
        on_left, on_right = _prefix_codes(before[rows]), _prefix_codes(after[rows])
        for left in range(reach + 1):
            fine = (most_left[rows] >= left) & (most_right[rows] >= reach - left)
            own = rows[fine]
            with np.errstate(over="ignore"):
                code = on_left[fine, left] * np.uint64(0x9E3779B97F4A7C15) + on_right[fine, reach - left]
                code = mixed(code + group[own].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            order = np.lexsort((docs[own], code))
            own, code = own[order], code[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            sizes = np.diff(np.append(starts, len(code)))
            low, high = np.repeat(docs[own[starts]], sizes), np.repeat(docs[own[starts + sizes - 1]], sizes)
            met = low != high
            own, low, high = own[met], low[met], high[met]
            add(own, np.full(len(own), left), np.full(len(own), reach - left), np.where(docs[own] == low, high, low))
    table = np.vstack(found)
    return pa.RecordBatch.from_arrays(
        [pa.array(table[:, 0]), pa.array(table[:, 1].astype(np.int32)), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3])],
        ["doc_id", "start_word", "end_word", "match_doc_id"],
    )


def _prefix_codes(table: np.ndarray) -> np.ndarray:
    """Codes of the first 0, 1, 2, ... words of each row."""
    codes = np.ones((len(table), table.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(table.shape[1]):
            codes[:, step + 1] = mixed(codes[:, step] + table[:, step].astype(np.uint64) + np.uint64(1))
    return codes


def _matches(contexts: DataFrame, head: int, least: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column("head").to_numpy()
            last = np.flatnonzero(heads != heads[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            tail_differs = held and held[-1].column("head")[-1].as_py() != heads[-1]
            if cut or tail_differs:
                yield neighbor_matches(_joined([*held, batch.slice(0, cut)]), head, least)
                held = []
            held.append(batch.slice(cut))
            release()
        if held:
            yield neighbor_matches(_joined(held), head, least)
        held.clear()
        release()

    order = ["head", "after", "before", "doc_id"]
    ordered = contexts.repartition("head").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "doc_id long, start_word int, end_word int, match_doc_id long")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([batch for batch in batches if batch.num_rows])


def find_repeats(docs: DataFrame, key: str = "doc_id", least: int = MIN_WORDS, head: int = HEAD) -> DataFrame:
    """Rows of doc_id, start_word, end_word, n_words and match_doc_id.

    A row is a stretch of `doc_id`, from start_word up to but without
    end_word, made of overlapping passages of at least `least` words that other
    documents hold too; match_doc_id is the smallest of those seen next to it.
    Words are cut at white space and compared with A-Z in lower case. Documents
    without such a passage, among them null, empty and short texts, have no
    row. Rows that repeat an id and text count once, rows with a null id are
    left out. Documents whose words are all the same as another's are one
    stretch, and only the smallest id of such a group enters the sort. Heads
    with more than GROUP suffixes are not sorted: each window that keeps such a
    suffix gives the code of its words, and equal codes are grouped.
    """
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    with temporary(docs.sparkSession):
        found = materialize(_suffixes(frame, head, least))
        classes = found.groupBy("text_code").agg(
            F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("heads").alias("heads"), F.first("places").alias("places")
        )
        classes = materialize(classes)
        suffixes = classes.select("text_code", "doc_id", F.explode(F.arrays_zip(F.col("heads").alias("head"), F.col("places").alias("place"))).alias("s"))
        suffixes = suffixes.select("text_code", "doc_id", "s.head", "s.place")
        often = suffixes.groupBy("head").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        often = materialize(often.where("low <> high").select("head", "n"))  # so that the join can split a head that very many documents hold
        hot = often.where(F.col("n") > GROUP).select("head")
        cold = suffixes.join(often.where(F.col("n") <= GROUP), "head")
        wanted = cold.select("text_code", "doc_id", F.struct("head", "place").alias("suffix"))
        wanted = wanted.groupBy("text_code", "doc_id").agg(F.collect_list("suffix").alias("suffixes"))
        matches = _matches(_contexts(frame, wanted, head, least), head, least)
        hottest = np.array([row["head"] for row in hot.collect()], np.int64)  # at most one in GROUP suffixes
        if len(hottest):
            ids = materialize(suffixes.join(F.broadcast(hot), "head").select("doc_id").distinct())
            windows = materialize(_windows(frame.join(few(ids), "doc_id", "left_semi"), hottest, head, least))
            matches = matches.unionByName(_hot_matches(windows, least))
        copied = classes.where("doc_id <> last").select("text_code", F.col("doc_id").alias("low"), F.col("last").alias("high"))
        copies = found.join(copied, "text_code").select(
            "doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"),
            F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("match_doc_id"),
        )
        return keep(_merged(matches.unionByName(copies)))


def _merged(spans: DataFrame) -> DataFrame:
    """Join overlapping stretches of a document."""
    spans = spans.groupBy("doc_id", "start_word", "end_word").agg(F.min("match_doc_id").alias("match_doc_id"))
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_word") > reach), 1).otherwise(0)
    spans = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    joined = spans.groupBy("doc_id", "island").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("match_doc_id").alias("match_doc_id")
    )
    return joined.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_doc_id")
