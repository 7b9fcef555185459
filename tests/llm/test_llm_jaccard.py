import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of, text_of
from tastegrid.llm import components, jaccard


def shingle_set(text, length=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[k : k + length]) for k in range(max(1, len(words) - length + 1))) if words else frozenset()


def brute(rows, length=4, percent=85):
    """One (doc_id, size, component) per row, by comparing all sets that share a shingle."""
    sets = [shingle_set(text, length) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for place, own in enumerate(sets):
        for other, shared in Counter(k for s in own for k in lists[s]).items():
            if 100 * shared >= percent * (len(own) + len(sets[other]) - shared):
                parent[root(place)] = root(other)
        for s in own:
            lists[s].append(place)
    groups = defaultdict(list)
    for place in range(len(rows)):
        groups[root(place)].append(rows[place][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows))), key=str)


def found(frame):
    return sorted((tuple(row) for row in jaccard.join_groups(frame).collect()), key=str)


@pytest.mark.parametrize("block", [3, 256])
def test_groups_equal_brute_force_at_any_block_size(spark, many_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert found(rows_of(spark, many_rows)) == brute(many_rows)


def test_groups_of_odd_rows(edge_docs, edge_rows):
    assert found(edge_docs) == brute(edge_rows)


def test_no_rows(empty_docs):
    assert found(empty_docs) == []
    assert jaccard.keep_one(empty_docs).collect() == []


def test_one_of_each_group_stays(edge_docs):
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted(str(row["doc_id"]) for row in kept.collect())
    assert ids == sorted(map(str, [None, None, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 14]))


def test_an_id_with_a_duplicate_and_a_unique_text(spark):
    draw = random.Random(6)
    copied, own, other = (text_of(draw, 60) for _ in range(3))
    rows = [(1, copied), (2, copied), (2, own), (2, own), (2, None), (2, ""), (3, copied), (3, copied), (4, other)]
    frame = rows_of(spark, [(doc, text, "en", "src0") for doc, text in rows])
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    found = sorted(((row["doc_id"], row["text"]) for row in kept.collect()), key=str)
    assert found == sorted([(1, copied), (2, own), (2, None), (2, ""), (4, other)], key=str)


def test_divide_skip_equals_counting():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50))) for _ in range(120)]
    sets += [np.unique(np.append(s[1:], 61)) for s in sets[:40]]
    index = jaccard.InvertedIndex([s.astype(np.int64) for s in sets])
    for query in sets:
        shared = [len(np.intersect1d(query, other)) for other in sets]
        want = [k for k, n in enumerate(shared) if 100 * n >= 85 * (len(query) + len(sets[k]) - n)]
        assert index.search(query.astype(np.int64), 85).tolist() == want


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 499), (7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {499: 499, 500: 499}
    assert got == want


@pytest.mark.parametrize("settings", [{}, {"LEADERS": 4, "BLOCK": 64, "RUN": 2}])
def test_links_given_out_are_in_proportion_to_the_texts(spark, monkeypatch, settings):
    """Near copies of which hardly any link with a given one, at two sizes."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    counted = []
    monkeypatch.setattr(jaccard, "components", lambda edges: counted.append(edges.count()) or components.components(edges))
    draw = random.Random(2)
    base = text_of(draw, 200).split()
    per_text = []
    for size in (100, 300):
        rows = []
        for doc in range(size):
            own = list(base)
            for _ in range(draw.randint(1, 6)):
                own[draw.randrange(200)] = text_of(draw, 1)
            rows.append((doc, " ".join(own), "en", "src0"))
        counted.clear()
        assert found(rows_of(spark, rows)) == brute(rows)
        per_text.append(sum(counted) / size)
    assert per_text[1] < 1.6 * max(per_text[0], 1)


def test_a_chain_whose_members_do_not_link_with_most_others(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    draw = random.Random(5)
    words = text_of(draw, 700).split()
    rows = [(step, " ".join(words[8 * step : 8 * step + 150]), "en", "src0") for step in range(60)]
    draw.shuffle(rows)
    want = brute(rows)
    assert {row[2] for row in want} == {0} and found(rows_of(spark, rows)) == want


def searched(monkeypatch):
    """Where the numbers of rows are noted that the search of groups is given."""
    counted, search = [], jaccard._search_groups
    monkeypatch.setattr(jaccard, "_search_groups", lambda rows, percent: counted.append(rows.count()) or search(rows, percent))
    return counted


def test_rows_searched_are_in_proportion_to_a_group_of_short_texts(spark, monkeypatch):
    """Near copies of which hardly any link are not copied once per 8 others."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    counted = searched(monkeypatch)
    draw = random.Random(12)
    base = text_of(draw, 40).split()
    per_text = []
    for size in (80, 240):
        rows = []
        for doc in range(size):
            own = list(base)
            for place in draw.sample(range(40), 2):
                own[place] = text_of(draw, 1)
            rows.append((doc, " ".join(own), "en", "src0"))
        counted.clear()
        assert found(rows_of(spark, rows)) == brute(rows)
        per_text.append(counted[-1] / size)
    assert per_text[1] < 1.6 * max(per_text[0], 1)


def test_a_passage_of_many_texts_does_not_make_them_a_group(spark, monkeypatch):
    """A third of each text is in all, too little for a link; the near copies among them are found."""
    counted = searched(monkeypatch)
    draw = random.Random(13)
    passage = text_of(draw, 60)
    rows = [(doc, f"{text_of(draw, 120)} {passage}", "en", "src0") for doc in range(150)]
    rows += [(doc + 150, rows[doc][1] + " more", "en", "src0") for doc in range(3)]
    got = sorted((tuple(row) for row in jaccard.join_groups(rows_of(spark, rows), length=5, percent=80).collect()), key=str)
    want = brute(rows, 5, 80)
    assert got == want and sum(row[0] != row[2] for row in want) == 3
    assert sum(counted) <= 12
