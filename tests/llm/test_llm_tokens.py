import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tastegrid.llm import tokens
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def expected(library, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, out = 0, []
    for doc, text, *_ in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def round_trip(spark, frame):
    read = tokens.read(spark, tokens.write(frame)).select("doc_id", "start", "n_tokens", tokens.crc32_of("ids").alias("c"))
    return sorted((tuple(row) for row in read.collect()), key=lambda row: row[1])


def test_files_hold_what_the_library_gives(spark, library, edge_docs, edge_rows):
    assert round_trip(spark, edge_docs) == expected(library, edge_rows)


def test_shards_are_cut_by_size(spark, library, edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 100)
    assert round_trip(spark, edge_docs) == expected(library, edge_rows)


def test_no_rows(spark, empty_docs):
    assert round_trip(spark, empty_docs) == []


def test_parts_of_words_give_the_ids_of_whole_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PARTS", 300)
    draw, letters = random.Random(2), "ab Z'sté,.!?0 9’—“̸́=<>\n\t日本ßÉ÷×’tre'll'RE  \x1c\x85ΣςİǅⅧ½_-|#$"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += ["x<|endoftext|>y", "", None, "a<|startoftext|> b", "don't can'T 3's"]
    coder = tokens.PartEncoder(tokens.tokenizer_path())
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        flat, counts = coder.encode(pa.array(part, pa.string()))
        got = [own.tolist() for own in np.split(flat, np.cumsum(counts)[:-1])]
        assert got == [library.encode(text or "", add_special_tokens=False).ids for text in part]
