import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from conftest import rows_of
from public_tokenizers import path
from tastegrid.llm import alignment, queries
from tokenizers import Tokenizer

ODD = "ab Z'sté,.!?0 9’—“̸́=<>\n\t日本ßÉ÷×'tre'll'RE  \x1c\x85ΣςİǅⅧ½_-|#$   　  𝕏🙂aaaa▁\x00"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=path(alignment.SECOND))


def byte_level():
    """The bytes that the characters of byte-level tokens stand for."""
    byte_of, more = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            byte_of[chr(byte)] = byte
        else:
            byte_of[chr(256 + more)] = byte
            more += 1
    return byte_of


def tokens_of(libraries, text):
    """(id, begin, end) of either tokenizer's tokens, or None."""
    first, second = libraries
    byte_of = byte_level()
    a = [(k, bytes(byte_of[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in second.encode(text):
        name = second.id_to_piece(k)
        b.append((k, bytes([int(name[3:5], 16)]) if second.is_byte(k) else name.replace("▁", " ").encode()))
    if not text or any(b"".join(own for _, own in side) != (" " + text).encode() for side in (a, b)):
        return None
    placed = []
    for side in (a, b):
        at, found = 0, []
        for k, own in side:
            found.append((k, at, at + len(own)))
            at += len(own)
        placed.append(found)
    return placed


def aligned(libraries, text):
    """n_a, n_b, n_groups, n_links, groups and the links with their number."""
    placed = tokens_of(libraries, text or "")
    if placed is None:
        return 0, 0, 0, 0, "", Counter()
    a, b = placed
    ends = sorted({end for _, _, end in a} & {end for _, _, end in b})
    groups = [
        "|".join(",".join(str(k) for k, _, end in side if low < end <= high) for side in (a, b))
        for low, high in zip([0, *ends], ends)
    ]
    links = Counter((k, m) for k, x, y in a for m, v, w in b if x < w and v < y)
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute(libraries, rows):
    known = {text: aligned(libraries, text) for text in {row[1] for row in rows}}
    documents, most = Counter(), defaultdict(int)
    for _, text, *_ in rows:
        documents.update(known[text][5].keys())
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    found = []
    for doc, text, *_ in rows:
        *measures, sums, links = known[text]
        best = sum(n for pair, n in links.items() if documents[pair] == most[pair[0]])
        found.append((doc, *measures, best, sum(n * documents[pair] for pair, n in links.items()), sums))
    return sorted(found, key=str)


def found(frame):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str)


@pytest.fixture(scope="module")
def copied_rows(many_rows):
    """Near copies, texts that the tokenizers don't give back, and one text that a third of rows have."""
    odd = ["▁a b", "<|endoftext|> <s> <0x41>", "a　 b", " ", "\x00x", "x" * 900, "naïve café", "  two  spaces "]
    rows = many_rows[:150] + [(1000 + k, text, "en", "src0") for k, text in enumerate(odd)]
    return rows + [(2000 + k, "the same text in many documents", "en", "src1") for k in range(90)]


@pytest.mark.parametrize("setting", [{}, {"HOT_SHARE": 2, "BROADCAST_PAIRS": 0, "_BATCH_BYTES": 900}])
def test_measures_equal_brute_force(spark, libraries, copied_rows, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(alignment, name, value)
    assert found(alignment.align(rows_of(spark, copied_rows))) == brute(libraries, copied_rows)


def test_query_on_odd_rows(spark, libraries, edge_docs, edge_rows, tmp_path):
    rows = [(doc, text if text is None or len(text) < 9000 else text[:9000]) for doc, text, *_ in edge_rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.op12_token_alignment(spark, str(tmp_path))) == brute(libraries, rows)
    assert len(found(alignment.align(edge_docs))) == len(edge_rows)


def test_no_rows(empty_docs):
    assert found(alignment.align(empty_docs)) == []


def test_odd_texts_in_batches(libraries):
    draw = random.Random(1)
    code = alignment.Aligner(path(alignment.FIRST), path(alignment.SECOND))
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randrange(60))) for _ in range(2500)]
    for start in range(0, len(texts), 600):
        part = texts[start : start + 600]
        got = code.align(pa.array([" " + text if text else "" for text in part]))
        columns = [got[name].to_pylist() for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
        links = [Counter({divmod(d["pair"], code.n_second): d["uses"] for d in own}) for own in got["links"].to_pylist()]
        for k, text in enumerate(part):
            assert (*(column[k] for column in columns), links[k]) == aligned(libraries, text), text
