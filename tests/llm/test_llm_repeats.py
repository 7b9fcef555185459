import random
from collections import defaultdict

import pytest
from conftest import rows_of, text_of
from tastegrid.llm import repeats


def lowered(text):
    return [w.lower() for w in (text or "").split()]


def brute(rows, least):
    """Marked words per id: those in a run of `least` words that another id holds."""
    texts = {}
    for doc, text, *_ in rows:
        if doc is not None and text is not None:
            texts.setdefault(doc, []).append(lowered(text))
    holders = defaultdict(set)
    for doc, own in texts.items():
        for words in own:
            for k in range(len(words) - least + 1):
                holders[tuple(words[k : k + least])].add(doc)
    marked = defaultdict(set)
    for doc, own in texts.items():
        for words in own:
            for k in range(len(words) - least + 1):
                if len(holders[tuple(words[k : k + least])]) > 1:
                    marked[doc].update(range(k, k + least))
    return dict(marked)


def found(frame, **options):
    marked = defaultdict(set)
    for row in repeats.find_repeats(frame, **options).collect():
        assert row["n_words"] == row["end_word"] - row["start_word"] and row["match_doc_id"] != row["doc_id"]
        span = set(range(row["start_word"], row["end_word"]))
        assert not span & marked[row["doc_id"]]
        marked[row["doc_id"]] |= span
    return dict(marked)


@pytest.mark.parametrize("least, head", [(50, 8), (20, 4)])
def test_stretches_equal_brute_force(spark, many_rows, least, head):
    assert found(rows_of(spark, many_rows), least=least, head=head) == brute(many_rows, least)


def test_hot_heads_are_dealt_out(spark, many_rows, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 25)
    got, want = found(rows_of(spark, many_rows)), brute(many_rows, 50)
    assert all(got[doc] <= want[doc] for doc in got)
    assert set(got) == set(want)


def test_passages_of_two_documents_around_a_hot_head(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 25)
    draw = random.Random(12)
    line, rows = text_of(draw, 30), []
    for _ in range(100):  # 50 words that two documents share, most of them the line of all
        passage = f"{text_of(draw, 10)} {line} {text_of(draw, 10)}"
        rows += [(len(rows) + k, f"{text_of(draw, 9)} {passage} {text_of(draw, 9)}", "x", "y") for k in range(2)]
    want = brute(rows, 50)
    assert len(want) == 200
    assert found(rows_of(spark, rows)) == want


def test_hot_heads_equal_brute_force(spark, many_rows, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 25)
    assert found(rows_of(spark, many_rows)) == brute(many_rows, 50)


def test_repeated_words_do_not_hide_a_passage(spark):
    rows = [(1, "a " * 80 + "b " * 30, "x", "y"), (2, "c d " + "a " * 70, "x", "y"), (3, "e " * 200, "x", "y")]
    assert found(rows_of(spark, rows)) == brute(rows, 50)


def test_odd_rows(edge_docs, edge_rows):
    rows = [row for row in edge_rows if row[0] != 14]  # one id with two texts is marked by either
    assert {k: v for k, v in found(edge_docs).items() if k != 14} == brute(rows, 50)


def test_no_rows(empty_docs):
    assert found(empty_docs) == {}
