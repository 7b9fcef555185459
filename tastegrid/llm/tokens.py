"""Token ids of whole documents in flat memory-mapped files.

A dataset is a folder of shards. `ids-*.bin` holds the ids of the shard's
documents one after another as little-endian unsigned integers (16 bit when
the vocabulary fits, else 32 bit); `docs-*.bin` holds the shard's document
offsets, one more than documents, as little-endian unsigned 64-bit integers
that count ids from the start of the whole dataset. Shards follow one another
in ascending doc_id.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.frames import pieces
from tastegrid.llm.text import LOWER, SPACES, words
from tastegrid.session import materialize, scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Distinct parts of words whose ids a worker keeps (about 30 bytes each).
KNOWN_PARTS = 1_000_000
#: Bytes of text that are encoded at a time.
_PIECE_BYTES = 1 << 19
SHARD_BYTES = 64 << 20


@dataclass
class TokenDataset:
    """Where the files are, their id type, and one row per shard."""

    folder: str
    width: str
    shards: DataFrame


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WholeEncoder:
    """Ids of whole texts from the tokenizer as it is."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text; null counts as empty."""
        found = [self.tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((one for ids in found for one in ids), np.uint32, counts.sum()), counts


class PartEncoder(WholeEncoder):
    """The same ids, with each distinct part of a word encoded once.

    Right for tokenizers that drop white space, lower letters one by one and
    part words into runs of letters, single digits, runs of other characters
    and endings after an apostrophe. Texts are cut only where such a tokenizer
    always parts them: at white space, between a letter and a digit or mark,
    at digits. A letter is one of ASCII or of U+00C0 to U+00FF; other
    characters stay with their neighbours. Texts with the string of a special
    token are encoded whole. Ids of known parts are kept by a 64-bit hash.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.codes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, codes: np.ndarray, parts: list[str]) -> None:
        found = [
            one.ids
            for start in range(0, len(parts), 4096)
            for one in self.tokenizer.encode_batch_fast(parts[start : start + 4096], add_special_tokens=False)
        ]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter((one for own in found for one in own), np.uint32, sizes.sum())
        starts = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        # codes stay in order, ids in the order of learning
        place = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, place, codes)
        self.sizes = np.insert(self.sizes, place, sizes)
        self.starts = np.insert(self.starts, place, starts)
        self.ids = np.append(self.ids, ids)

    def _place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.codes, codes)
        inside = place < len(self.codes)
        inside[inside] = self.codes[place[inside]] == codes[inside]
        return place, inside

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = words(texts, SPACES, LOWER, _part_ends)
        codes, first, which = np.unique(cut.code, return_index=True, return_inverse=True)
        place, known = self._place(codes)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.codes) + len(new) > KNOWN_PARTS:  # start anew with this batch
                new = np.arange(len(codes))
                self._forget()
            data = cut.data.tobytes()
            at = zip(cut.begin[first[new]], cut.end[first[new]])
            self._learn(codes[new], [data[a:b].decode() for a, b in at])
            place, known = self._place(codes)
        where = place[which]
        sizes = self.sizes[where]
        flat = self.ids[_ranges(self.starts[where], sizes)]
        through = np.append(0, np.cumsum(sizes))
        counts = through[cut.of[1:]] - through[cut.of[:-1]]
        return self._with_special(texts, flat, counts)

    def _with_special(self, texts: pa.Array, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return flat, counts
        own = np.split(flat, np.cumsum(counts)[:-1])
        whole, sizes = super().encode(texts.filter(pa.array(odd)))
        for row, ids in zip(np.flatnonzero(odd), np.split(whole, np.cumsum(sizes)[:-1])):
            own[row] = ids
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    through = np.cumsum(sizes)
    return np.repeat(starts - (through - sizes), sizes) + np.arange(through[-1] if len(through) else 0)


_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 ASCII mark, 3 other
_KIND[:128] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1


def _part_ends(data: np.ndarray) -> np.ndarray:
    """Places before which a word is cut."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 0
    left, right = kind[:-1], kind[1:]
    both = (left < 3) & (right < 3)
    ends = both & ((left != right) | (left == 1)) & ~((data[:-1] == 0x27) & (right == 0))
    return np.flatnonzero(ends) + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> WholeEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return (PartEncoder if os.path.basename(path) == TOKENIZER else WholeEncoder)(path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    folder: str | None = None,
) -> TokenDataset:
    """Encode every text, end it with END_ID and write the shards.

    Documents follow ascending id (null first), then text, so repeated rows
    stay side by side. Null and empty texts become the end id alone. Only the
    two columns are read. Ranges of ids are sorted in parallel; each task
    writes one shard under a name of its own, and the returned rows name the
    files of the attempts that ended well, so a repeated task leaves no trace
    in the dataset. Shard bases are prefix sums over the shards' rows, which
    are as many as tasks.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "token-ids")).rstrip("/")
    path = tokenizer or tokenizer_path()
    width = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        code = encoder(path)
        name, total, sink, parts = "", 0, None, 0
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []

        def row() -> pa.RecordBatch:
            sink.close()
            lists = np.concatenate(lengths)
            with store.open_output_stream(f"{place}/lengths-{name}.bin") as out:
                out.write(lists.astype("<u8").tobytes())
            with store.open_output_stream(f"{place}/keys-{name}.arrow") as out:
                block = pa.record_batch([pa.concat_arrays(ids)], ["doc_id"])
                with pa.ipc.new_stream(out, block.schema) as stream:
                    stream.write_batch(block)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in (
                    (TaskContext.get().partitionId(), pa.int32()), (parts, pa.int32()), (name, pa.string()),
                    (len(lists), pa.int64()), (int(lists.sum()), pa.int64()))],
                ["part", "piece", "name", "documents", "ids"],
            )

        for batch in batches:
            for piece in pieces(batch, ["text"], _PIECE_BYTES):
                if sink is None:
                    name, total, lengths, ids = uuid.uuid4().hex, 0, [], []
                    sink = store.open_output_stream(f"{place}/ids-{name}.bin")
                flat, counts = code.encode(piece.column("text"))
                ended = np.insert(flat, np.cumsum(counts), END_ID)
                sink.write(ended.astype(width).tobytes())
                total += len(ended) * int(width[2])
                lengths.append(counts + 1)
                ids.append(piece.column("doc_id"))
                if total >= SHARD_BYTES:
                    yield row()
                    sink, parts = None, parts + 1
        if sink is not None:
            yield row()

    written = materialize(
        ordered.mapInArrow(run, "part int, piece int, name string, documents long, ids long")
    )
    shards = _with_bases(spark, written)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with store.open_input_file(f"{place}/lengths-{shard['name']}.bin") as source:
                    lengths = np.frombuffer(source.read(), "<u8")
                offsets = np.cumsum(np.insert(lengths, 0, np.uint64(shard["base"])), dtype=np.uint64)
                with store.open_output_stream(f"{place}/docs-{shard['name']}.bin") as out:
                    out.write(offsets.astype("<u8").tobytes())
            yield batch

    indexed = materialize(shards.mapInArrow(index, shards.schema))
    return TokenDataset(folder, width, indexed)


def _with_bases(spark: SparkSession, written: DataFrame) -> DataFrame:
    """Add each shard's number and the count of ids before it."""
    rows = sorted(written.collect(), key=lambda row: (row["part"], row["piece"]))
    base, table = 0, []
    for number, row in enumerate(rows):
        table.append((number, row["name"], row["documents"], row["ids"], base))
        base += row["ids"]
    schema = "shard int, name string, documents long, ids long, base long"
    shards = spark.createDataFrame(table, schema)
    return shards.repartition(max(1, min(len(table), 1000)), "shard") if table else shards


def read(spark: SparkSession, dataset: TokenDataset) -> DataFrame:
    """Rows of doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers).

    Shards on a mounted file system are mapped into memory, others are read
    as streams; a batch holds a bounded number of ids.
    """
    folder, width = dataset.folder, dataset.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)

        def mapped(name: str, kind: str) -> np.ndarray:
            if isinstance(store, fs.LocalFileSystem):
                path = f"{place}/{name}"
                return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
            with store.open_input_file(f"{place}/{name}") as source:
                return np.frombuffer(source.read(), kind)

        for batch in batches:
            for shard in batch.to_pylist():
                flat, bounds = mapped(f"ids-{shard['name']}.bin", width), mapped(f"docs-{shard['name']}.bin", "<u8")
                bounds = bounds.astype(np.int64)
                with store.open_input_file(f"{place}/keys-{shard['name']}.arrow") as source:
                    keys = pa.ipc.open_stream(source).read_all().column("doc_id").combine_chunks()
                keys = keys if isinstance(keys, pa.Array) else pa.concat_arrays(keys.chunks)
                steps = np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], 1 << 18))
                steps = np.unique(np.append(steps, len(bounds) - 1))
                steps = np.unique(np.insert(steps, 0, 0))
                for first, last in zip(steps[:-1], steps[1:]):
                    own = bounds[first : last + 1]
                    chunk = np.asarray(flat[own[0] - bounds[0] : own[-1] - bounds[0]]).astype("<u4")
                    binary = pa.Array.from_buffers(
                        pa.large_binary(), last - first,
                        [None, pa.py_buffer(((own - own[0]) * 4).tobytes()), pa.py_buffer(chunk.tobytes())],
                    ).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, last - first), pa.array(own[:-1]), pa.array(np.diff(own)), binary],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return dataset.shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(name: str) -> Column:
    """Unsigned crc32 of a binary column."""
    return F.crc32(F.col(name))
