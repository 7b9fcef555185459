import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import rows_of
from tastegrid.llm import queries, spelling

LETTERS = "abcdeéü"


def words_of(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_of(words):
    """All pairs of words of near lengths, compared."""
    sizes = defaultdict(list)
    for word in words:
        sizes[len(word)].append(word)
    return {
        word: [other for size in (len(word) - 1, len(word), len(word) + 1) for other in sizes[size] if is_near(word, other)]
        for word in words
    }


def brute(rows):
    words = words_of(rows)
    near, form = near_of(words), {}
    for word, n in words.items():
        best = min(near[word], key=lambda other: (-words[other], other), default=None)
        form[word] = best if best is not None and words[best] >= 10 * n else None

    def root(word):
        return word if form[word] is None else root(form[word])

    found = [(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()]
    return sorted(found, key=str)


def found(frame):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str)


@pytest.fixture(scope="module")
def variant_rows():
    """Frequent words, with variants that are rarer by steps, and many words of few letters."""
    draw = random.Random(12)
    rows, pool = [], []

    def edit(word):
        k = draw.randrange(len(word))
        return draw.choice([word[:k] + draw.choice(LETTERS) + word[k:], word[:k] + word[k + 1 :], word[:k] + draw.choice(LETTERS) + word[k + 1 :]])

    for _ in range(40):
        base = "".join(draw.choice(LETTERS) for _ in range(draw.randint(7, 13)))
        pool += [base] * 300
        for _ in range(6):
            one = edit(base)
            pool += [one] * draw.choice([2, 3, 25, 30])
            pool += [edit(one)] * 2
    pool += ["".join(draw.choice("ab") for _ in range(draw.randint(7, 9))) for _ in range(900)]
    pool += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["a" * 400, "a" * 401, "b" * 400] * 2
    draw.shuffle(pool)
    for start in range(0, len(pool), 60):
        own = pool[start : start + 60]
        text = " ".join(word.upper() if draw.random() < 0.1 else word for word in own)
        rows.append((start, text.replace(" ", draw.choice([" ", ", ", "\n", "1", "-"])), "en", "src0"))
    return rows


def test_variants_equal_brute_force(spark, variant_rows, monkeypatch):
    monkeypatch.setattr(spelling, "_COUNTED", 50)
    want = brute(variant_rows)
    assert found(spelling.group_variants(rows_of(spark, variant_rows))) == want
    assert any(row[1] not in (None, row[2]) for row in want)  # chains of forms


def test_query_on_odd_rows(spark, edge_docs, edge_rows, tmp_path):
    odd = [(20, "Straße ÀÉÎÕÜ×÷ àéîõü×÷ àéîõü×÷ ÀÉÎÕÜ×÷", None, None), (None, "Ordinary ordinary ORDINARX ordinarx", None, None)]
    rows = edge_rows + odd + odd
    edge_docs.unionByName(rows_of(spark, odd + odd)).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.op11_spelling_variants(spark, str(tmp_path))) == brute(rows)


def test_no_rows(empty_docs):
    assert found(spelling.group_variants(empty_docs)) == []


def test_pivots_are_the_cheapest_that_do_not_overlap():
    draw = random.Random(1)
    for _ in range(500):
        places = draw.sample(range(12), draw.randint(3, 8))
        prefix = sorted((draw.randrange(9), place) for place in places)
        pairs = [(a, b) for a in prefix for b in prefix if a[1] + 2 <= b[1]]
        least = min(a[0] + b[0] for a, b in pairs)
        first, second = spelling.pivots_of(prefix)
        assert (first, second) in pairs and first[0] + second[0] == least


def test_a_chain_of_forms_ends_in_its_last(spark):
    chain = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(30)], "word string, form string")
    assert {tuple(row) for row in spelling.roots(chain).collect()} == {(f"w{k:02}", "w30") for k in range(30)}
