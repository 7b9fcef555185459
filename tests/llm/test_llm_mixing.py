import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from conftest import rows_of, text_of
from tastegrid.llm import mixing
from tastegrid.llm.mixing import Mix, mix_documents


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    made = []
    for k in range(600):
        source = "src0" if k % 3 == 0 else f"src{draw.randint(1, 9)}"
        made.append((k, text_of(draw, draw.randint(0, 40)), draw.choice(["en", "en", "de", "fr"]), source))
    return made


def level_of(row):
    digits = ""
    for char in reversed(row[3] or ""):
        if not char.isdigit() or len(digits) == 9:
            break
        digits = char + digits
    return (f"d{int(digits) % mixing.DOMAINS}" if digits else "-", row[2] or "-", row[3] or "-")


def budgets(rows, mix):
    """Give out tokens one level after another, filling up children until none is left over."""
    tokens = defaultdict(int)
    for row in rows:
        tokens[level_of(row)] += len((row[1] or "").split())
    room = {}
    for depth in (3, 2, 1):
        for path in {p[:depth] for p in tokens}:
            inside = tokens[path] * mix.max_epochs if depth == 3 else sum(v for p, v in room.items() if len(p) == depth + 1 and p[:depth] == path)
            room[path] = 0 if mix.weights.get(path) == 0 else inside
    share = {(): sum(tokens.values()) * mix.percent // 100}
    for depth in (1, 2, 3):
        for parent in [p for p in share if len(p) == depth - 1]:
            children = {p: mix.weights.get(p, 1) or 1 for p in room if len(p) == depth and p[:-1] == parent}
            left = share[parent]
            while True:
                total = sum(children.values())
                full = [p for p, w in children.items() if room[p] * total <= left * w]
                if not full:
                    break
                first = min(full, key=lambda p: (room[p] / children[p], p[-1]))
                share[first] = room[first]
                left -= room[first]
                del children[first]
            total = sum(children.values())
            share.update({p: left * w // total for p, w in children.items()})
    return {p: v for p, v in share.items() if len(p) == 3}, tokens


def brute(rows, mix):
    share, tokens = budgets(rows, mix)
    out = []
    for leaf, budget in share.items():
        own = [row for row in rows if level_of(row) == leaf]
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        for epoch in range(full + 1):
            def place(row):
                name = "-" if row[0] is None else str(row[0])
                return (hashlib.md5(f"{mix.seed}|{epoch}|{name}".encode()).hexdigest(), row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")
            total = 0
            for row in sorted(own, key=place):
                total += len((row[1] or "").split())
                if epoch == full and total > rest:
                    break
                out.append((row[0], *leaf, epoch, len((row[1] or "").split())))
    return sorted(out, key=str)


MIXES = [
    Mix(), Mix(mixing.DEFAULT_WEIGHTS, percent=60, max_epochs=2), Mix({("d1",): 0, ("d2", "en"): 9, ("d0", "de", "src4"): 5}, 90, 1, 3),
    Mix({("d3",): 50}, percent=80, max_epochs=3), Mix(percent=0), Mix(percent=100), Mix(percent=500, max_epochs=2),
]


@pytest.mark.parametrize("mix", MIXES)
@pytest.mark.parametrize("bucket", [4096, 20])
def test_choice_equals_brute_force_and_sql(spark, rows, mix, bucket, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 20_000 if bucket > 100 else 0)
    docs = rows_of(spark, rows)
    found = mix_documents(docs, mix).select("doc_id", *mixing.LEVELS, "epoch", "n_tokens")
    got = sorted((tuple(row) for row in found.collect()), key=str)
    assert got == brute(rows, mix)
    if bucket == 4096:
        docs.write.parquet(str(tmp_path / "d"))
        base = duckdb.connect()
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
        assert sorted(base.execute(mixing.mix_sql(mix)).fetchall(), key=str) == got


def test_odd_rows_and_names(spark, edge_docs, edge_rows, empty_docs):
    mix = Mix(percent=70, max_epochs=2)
    found = mix_documents(edge_docs, mix, prefix="__x_")
    assert found.columns[: len(edge_docs.columns)] == edge_docs.columns
    names = ["doc_id", *(f"__x_{n}" for n in (*mixing.LEVELS, "epoch", "n_tokens"))]
    assert sorted((tuple(row) for row in found.select(*names).collect()), key=str) == brute(edge_rows, mix)
    assert mix_documents(empty_docs, mix).collect() == []


def test_short_child_gives_to_siblings_before_the_rest_of_the_tree():
    words = {"src0": 100, "src4": 400, "src1": 500}
    rows = [(k, "w " * 10, "en", source) for source, n in words.items() for k in range(n // 10)]
    share, _ = budgets(rows, Mix(percent=60))
    assert share == {("d0", "en", "src0"): 100, ("d0", "en", "src4"): 200, ("d1", "en", "src1"): 300}
