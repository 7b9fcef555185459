import math

import numpy as np
import pytest
from tastegrid.llm import neighbors


def brute(rows, k=5):
    table = {i: np.array(v, float) for i, v in rows}
    ids = sorted(table)
    matrix = np.array([table[i] for i in ids])
    length = np.sqrt((matrix * matrix).sum(1))
    out = {}
    for place, query in enumerate(ids):
        if query % 50 == 0:
            scores = (matrix * matrix[place]).sum(1) / (length * length[place])
            order = [o for o in np.lexsort((ids, -scores)) if o != place][:k]
            out[query] = [(ids[o], scores[o]) for o in order]
    return out


def search(spark, rows, schema="vec_id long, embedding array<float>, label int, list int, v string, rank int"):
    frame = neighbors.usable(spark.createDataFrame([(*row, 1, 2, "x", 3) for row in rows], schema))
    index = neighbors.fit(frame, lists=8)
    if index is None:
        return {}
    got = {}
    for row in neighbors.nearest(frame, frame.where("vec_id % 50 = 0"), index).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert len(got[row["query_id"]]) == row["rank"]
    return got


@pytest.mark.parametrize("block", [64, 4096])
def test_recall_and_order(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    monkeypatch.setattr(neighbors, "QUERIES", 7)
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(6, 32))
    rows = [(k, draw.normal(size=32) if k % 3 else centers[k % 6] + 0.05 * draw.normal(size=32)) for k in range(1500)]
    rows += [(2000 + k, centers[0]) for k in range(300)]  # equal vectors
    rows = [(k, v.astype(np.float32).tolist()) for k, v in rows]
    got, want = search(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert got[2000] == want[2000]  # ties to the smaller ids


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [math.nan, 1.0]),
        (6, [math.inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (100, [0.0, 0.0]),
    ]
    assert search(spark, rows) == {
        0: [(1, 1.0), (50, pytest.approx(2**-0.5))], 50: [(0, pytest.approx(2**-0.5)), (1, pytest.approx(2**-0.5))],
    }


def test_few_and_no_vectors(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 2.0])]) == {}


def test_abandoning_keeps_the_nearest():
    draw = np.random.default_rng(7)
    rows = draw.normal(size=(3000, 64))
    rotation, _ = np.linalg.qr(draw.normal(size=(64, 64)))
    scan = neighbors.Scan(np.arange(3000), rows, rotation)
    missed = 0
    for query in range(0, 200, 10):
        cosines = rows @ rows[query] / np.linalg.norm(rows, axis=1) / np.linalg.norm(rows[query])
        cosines[query] = -2
        want = np.argsort(-cosines)[:5]
        missed += len(set(want) - {i for _, i in scan.nearest(query, rows[query], -1.0, 5)})
    assert missed <= 3 and scan.scored < 20 * 1500
