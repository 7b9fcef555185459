import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import lists, pairs_frame, random_pairs
from tastegrid.operators import ordering, pairs, ranking


def popularity_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "item_id bigint, popularity bigint")


def ranked(counts):
    return sorted(counts, key=lambda item: (-counts[item], str(item)))


def test_ordered_index_is_dense_and_ordered(spark):
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(500)]
    frame = spark.createDataFrame([(v, at) for at, v in enumerate(values)], "v int, at int")
    rows = ordering.ordered_index(frame.repartition(7), [F.col("v").desc(), F.col("at")]).collect()
    order = [at for _, at in sorted((r["index"], r["at"]) for r in rows)]
    assert order == sorted(range(500), key=lambda at: (-values[at], at))
    assert sorted(r["index"] for r in rows) == list(range(500))


def test_ranking_breaks_ties_by_id_text(spark):
    counts = {9: 2, 10: 2, 3: 5, 20: 0}
    rows = ranking.popularity_ranking(popularity_frame(spark, counts)).orderBy("place").collect()
    assert [r["item_id"] for r in rows] == [3, 10, 9, 20]
    assert [r["place"] for r in rows] == [1, 2, 3, 4]


@pytest.mark.parametrize("head_size", [1, 4, 10_000])
@pytest.mark.parametrize("k", [1, 5])
def test_first_unseen_equals_a_full_scan(spark, head_size, k):
    rng = random.Random(k)
    counts = {item: rng.randrange(6) for item in range(700)}
    order = ranked(counts)
    seen = random_pairs(8, 700, 0.02, 11, heavy=(1,))
    seen += [(20, item) for item in order[:650]]  # a user who knows the top of the list
    seen += [(21, item) for item in order]  # and one who knows everything
    users = list(range(10)) + [20, 21]
    found = ranking.first_unseen(
        spark.createDataFrame([(u,) for u in users], "user_id bigint"),
        pairs_frame(spark, seen), ranking.popularity_ranking(popularity_frame(spark, counts)),
        k, head_size,
    )
    known = set(seen)
    expected = {u: [i for i in order if (u, i) not in known][:k] for u in users}
    assert lists(found) == {u: items for u, items in expected.items() if items}


def test_top_k_orders_and_drops_infinite_scores(spark):
    rows = [
        (1, 10, 1.0, 4), (1, 9, 1.0, 5), (1, 8, 1.0, 3), (1, 7, float("-inf"), 1),
        (1, 6, float("nan"), 2), (1, 5, 2.0, 6), (1, 4, 1.0 + 1e-12, 7),
    ]
    scores = spark.createDataFrame(
        rows, "user_id bigint, item_id bigint, score double, place bigint"
    )
    assert lists(ranking.top_k(scores, 4))[1] == [5, 8, 10, 9]
    with pytest.raises(ValueError):
        ranking.top_k(scores, 0)


@pytest.mark.parametrize("bins", [2, 1024])
def test_medians_of_many_columns_are_exact(spark, bins):
    rng = np.random.default_rng(4)
    size = 200
    columns = {
        "spread": rng.lognormal(sigma=20, size=size), "ties": rng.integers(0, 3, size).astype(float),
        "extreme": rng.choice([-1.7e308, 1.7e308, 5e-324, -0.0, 1.0], size), "same": np.full(size, 2.5),
        "near": 1.0 + rng.integers(0, 4, size) * 2.0**-52, "odd": rng.normal(size=size), "few": rng.normal(size=size),
    }
    rows = [[float(values[at]) for values in columns.values()] for at in range(size)]
    for at in range(size):
        rows[at][5] = rows[at][5] if at else None
        rows[at][6] = rows[at][6] if at < 2 else None
    frame = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in columns)).repartition(3)
    found = ordering.exact_medians(frame, list(columns), bins)
    for place, name in enumerate(columns):
        held = sorted(row[place] for row in rows if row[place] is not None)
        middle = held[(len(held) - 1) // 2], held[len(held) // 2]
        assert found[name] == (middle[0] if middle[0] == middle[1] else sum(middle) / 2), name


def test_medians_of_nothing(spark):
    frame = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert ordering.exact_medians(frame, ["x", "y"]) == {"x": None, "y": 1.0}
    assert ordering.exact_medians(frame.limit(0), ["x", "y"]) == {"x": None, "y": None}


def test_item_popularity_fills_zero(spark):
    seen = pairs_frame(spark, [(1, 1), (2, 1)])
    items = spark.createDataFrame([(1,), (2,)], "item_id bigint")
    found = {r["item_id"]: r["popularity"] for r in pairs.item_popularity(seen, items).collect()}
    assert found == {1: 2, 2: 0}
