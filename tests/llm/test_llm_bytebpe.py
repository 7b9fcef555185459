import base64
import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from public_tokenizers import PATTERN
from tastegrid.llm import bytebpe, queries
from tastegrid.llm.segments import segments

ODD = "ab Z'sté,.!?0 9’—“̸́=<>\n\t日本ßÉ÷×'tre'll'RE  \x1c\x85ΣςİǅⅧ½_-|#$   　  ՘𝕏🙂aaaa▁\x00"


@pytest.fixture(scope="module")
def library():
    with open(bytebpe.ranks_path(), "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.Coder(bytebpe.ranks_path(), PATTERN)


def expected(library, rows):
    found = []
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        sums = (",".join(map(str, ids)).encode(), library.decode_bytes(ids))
        assert sums[1] == (text or "").encode()
        found.append((doc, len(ids), *(hashlib.sha256(data).hexdigest() for data in sums)))
    return sorted(found, key=str)


def run_query(spark, folder, frame):
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(row) for row in queries.op13_byte_bpe(spark, str(folder)).collect()), key=str)


def test_query_equals_the_library(spark, library, edge_docs, edge_rows, tmp_path):
    assert run_query(spark, tmp_path, edge_docs) == expected(library, edge_rows)


def test_query_on_no_rows(spark, empty_docs, tmp_path):
    assert run_query(spark, tmp_path, empty_docs) == []


def test_columns_stay_and_ids_decode(edge_docs, edge_rows):
    encoded = bytebpe.encode(edge_docs.withColumnRenamed("codes", "ids"))
    assert encoded.columns == [name for name in edge_docs.columns if name != "codes"] + ["ids", "decoded"]
    rows = bytebpe.decode(encoded, decoded="again").collect()
    assert all(bytes(row["again"]) == bytes(row["decoded"]) == (row["text"] or "").encode() for row in rows)
    assert len(rows) == len(edge_rows)


def odd_texts(count, seed=5):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randrange(60))) for _ in range(count)]
    texts += ["".join(draw.choice("abcdeinorst") for _ in range(draw.randrange(200))) for _ in range(count // 4)]
    planes = (32, 0x250), (0x250, 0xD800), (0xE000, 0x30000)
    return texts + ["".join(chr(draw.randrange(*draw.choice(planes))) for _ in range(30)) for _ in range(count // 4)]


def test_odd_texts_equal_the_library(coder, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN_PARTS", 500)
    texts = [*odd_texts(4000), None, "<|endoftext|>", "x" * 70_000, "ab" * 40_000 + "'" * 999, " " * 5000 + "x"]
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        flat, bounds = coder.encode(pa.array(part, pa.string()))
        data, at = coder.decode(flat, bounds)
        for k, text in enumerate(part):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text or ""), text
            assert data[at[k] : at[k + 1]].tobytes() == (text or "").encode()


def test_classes_of_all_known_characters_agree(coder):
    def kind(c):
        return "\t" if regex.match(r"\s", c) else "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else "#"

    # Unassigned characters go through the library, so the others must agree
    probes = {stand_in: probe for probe, stand_in in coder.cutter.probes}
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    known = coder.cutter.unknown.sub("", every)
    for stand_in, probe in probes.items():
        ours = "".join(c for c in known if kind(c) == stand_in)
        assert bytes(probe.encode_ordinary(known)).decode() == ours


def test_tables_grow_by_appending(coder):
    draw = random.Random(8)
    for _ in range(200):
        data = "".join(draw.choice("aeinorst日é") for _ in range(draw.randrange(1, 90))).encode()
        whole = bytebpe.PrefixTable(coder.vocabulary, data)
        table = bytebpe.PrefixTable(coder.vocabulary)
        at = 0
        while at < len(data):
            step = draw.randrange(1, 9)
            table.append(data[at : at + step])
            at += step
        assert table.last == whole.last and table.ids() == whole.ids()


def test_edits_are_computed_near_by_and_right(coder):
    draw = random.Random(3)
    made, total = 0, 0
    for _ in range(300):
        data = bytes(draw.choice(b"aeinorstlbc") for _ in range(draw.randrange(0, 900)))
        table = bytebpe.PrefixTable(coder.vocabulary, data)
        start = draw.randrange(len(data) + 1)
        end = min(len(data), start + draw.randrange(4))
        new = bytes(draw.choice(b"aeinorst") for _ in range(draw.randrange(5)))
        made += table.replace(start, end, new)
        total += len(data) - start
        fresh = bytebpe.PrefixTable(coder.vocabulary, data[:start] + new + data[end:])
        assert table.last == fresh.last and table.data == fresh.data
    assert made < total / 3


def test_text_edits_equal_encoding_anew(spark, coder, library):
    draw = random.Random(4)
    rows = [(None, None, 0, 5, "new"), ("abc", [], None, None, " more")]
    for text in odd_texts(400, 6):
        text = text + " plain words in between " + text[::-1]
        start = draw.choice([None, draw.randrange(len(text) + 3)])
        end = draw.choice([None, (start or 0) + draw.randrange(4)])
        rows.append((text, library.encode_ordinary(text), start, end, draw.choice([None, "", "'s", " ", "xyz", "é 1"])))
    rows[1] = ("abc", library.encode_ordinary("abc"), None, None, " more")
    frame = spark.createDataFrame(rows, "text string, ids array<int>, start int, end int, new string")
    for (text, _, start, end, new), got in zip(rows, bytebpe.edit(frame).collect()):
        text = text or ""
        start = min(len(text), len(text) if start is None else start)
        end = max(start, start if end is None else min(end, len(text)))
        want = text[:start] + (new or "") + text[end:]
        assert got["text"] == want and got["ids"] == library.encode_ordinary(want)


def test_segments_make_the_texts(edge_rows):
    texts = [row[1] for row in edge_rows] + odd_texts(300)
    cut = segments(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = b"".join(cut.distinct[p] for p in cut.which[cut.of[k] : cut.of[k + 1]])
        assert own == (text or "").encode()
    assert len(np.unique(cut.which)) == len(cut.distinct)
