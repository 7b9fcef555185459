import random
import re

import duckdb
import pytest
from conftest import rows_of, text_of
from tastegrid.llm import decontaminate


def shingle_set(text, length=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else set()


def brute(rows, items):
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        own = shingle_set(text)
        for row in rows:
            shared = len(own & shingle_set(row[1]))
            if own and 5 * shared >= 4 * len(own):
                out.append((row[0], item, shared, len(own), shared / len(own)))
    return sorted(out, key=str)


def items_of(spark, items):
    return spark.createDataFrame([(*item, "x", 2) for item in items], "item_id long, text string, doc_id string, n_item int")


@pytest.fixture(scope="module")
def case():
    draw = random.Random(5)
    items = [(k, text_of(draw, draw.choice([1, 3, 5, 6, 12, 40]))) for k in range(60)]
    rows = []
    for k in range(200):
        own = text_of(draw, draw.randint(0, 400)).split()
        for _ in range(draw.randint(0, 2)):
            leak = draw.choice(items)[1].split()
            for _ in range(draw.randint(0, 2)):
                leak[draw.randrange(len(leak))] = "zzz"
            at = draw.randint(0, len(own))
            own[at:at] = leak
        rows.append((k, draw.choice([" ", ", ", "\n"]).join(own).title(), "en", "src0"))
    rows += [(500, items[0][1].upper(), "en", "a"), rows[3], rows[3], (501, None, None, None), (502, "", "x", "y")]
    return rows, items + [(70, None), (71, ""), (None, text_of(draw, 9)), items[4]]


@pytest.mark.parametrize("block", [8 << 20, 900])
def test_leaks_equal_brute_force_in_one_or_many_blocks(spark, case, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rows, items = case
    docs, bench = rows_of(spark, rows), items_of(spark, items)
    got = sorted((tuple(row) for row in decontaminate.find_leaks(docs, bench).collect()), key=str)
    assert got == brute(rows, items) and len(got) > 20
    bad = {row[0] for row in got}
    kept = decontaminate.drop_leaked(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)


def test_sql_twin_agrees(spark, tmp_path, case):
    rows, items = case
    rows = [row for row in rows if rows.count(row) == 1]
    items = [item for item in items[:60] if items.count(item) == 1]
    rows_of(spark, rows).write.parquet(str(tmp_path / "d"))
    items_of(spark, items).write.parquet(str(tmp_path / "b"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    base.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    assert sorted(base.execute(decontaminate.LEAKS_SQL).fetchall(), key=str) == brute(rows, items)


def test_odd_and_no_rows(spark, edge_docs, empty_docs, edge_rows):
    items = [(1, edge_rows[11][1][:200]), (2, None), (3, "one"), (4, "ONE two, three")]
    bench = items_of(spark, items)
    got = sorted((tuple(row) for row in decontaminate.find_leaks(edge_docs, bench).collect()), key=str)
    assert got == brute(edge_rows, items) and got
    assert decontaminate.find_leaks(empty_docs, bench).collect() == []
    assert decontaminate.find_leaks(edge_docs, items_of(spark, [])).collect() == []
    assert decontaminate.drop_leaked(edge_docs, items_of(spark, [])).count() == edge_docs.count()
