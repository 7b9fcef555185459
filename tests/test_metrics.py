import math
import random

import pytest

from helpers import log_of, pairs_frame, toy_splits
from tastegrid.operators import metrics, pairs, segments


def recs_of(spark, lists):
    rows = [(u, at + 1, i) for u, items in lists.items() for at, i in enumerate(items)]
    return spark.createDataFrame(rows, "user_id bigint, rank int, item_id bigint")


def users_of(spark, users):
    return spark.createDataFrame([(u,) for u in users], "user_id bigint")


def items_of(spark, items):
    return spark.createDataFrame([(i,) for i in items], "item_id bigint")


def per_user(spark, lists, truth, k):
    rows = metrics.user_metrics(
        recs_of(spark, lists), pairs_frame(spark, truth), users_of(spark, lists), [k]
    )
    return {row["user_id"]: row for row in rows.collect()}


def test_recall_counts_hits_in_the_prefix(spark):
    assert per_user(spark, {0: [1, 2, 3]}, [(0, 2), (0, 4)], 2)[0]["recall"] == 0.5


def test_perfect_ranking_has_ndcg_one(spark):
    assert per_user(spark, {0: [2, 4, 1]}, [(0, 2), (0, 4)], 2)[0]["ndcg"] == pytest.approx(1.0)


def test_ndcg_discounts_late_hits(spark):
    found = per_user(spark, {0: [9, 8, 2]}, [(0, 2), (0, 4)], 3)[0]["ndcg"]
    assert found == pytest.approx(0.5 / (1 + 1 / math.log2(3)))


def test_aggregate_metrics(spark):
    lists = {0: [1, 2], 1: [3, 4]}
    row = metrics.evaluate(
        recs_of(spark, lists), pairs_frame(spark, [(0, 2), (1, 5)]), users_of(spark, lists),
        items_of(spark, range(1, 6)), [2],
    ).first()
    assert row["hit_rate"] == 0.5 and row["coverage"] == 0.8 and row["evaluated_users"] == 2


def test_user_with_an_empty_list_counts_as_zero(spark):
    lists = {0: [2], 1: []}
    row = metrics.evaluate(
        recs_of(spark, lists), pairs_frame(spark, [(0, 2), (1, 5), (7, 1)]),
        users_of(spark, lists), items_of(spark, [2, 5]), [1],
    ).first()
    assert row["evaluated_users"] == 2 and row["recall"] == 0.5


def test_several_cuts_from_one_list(spark):
    rows = metrics.evaluate(
        recs_of(spark, {0: [1, 2, 3]}), pairs_frame(spark, [(0, 2), (0, 3)]),
        users_of(spark, [0]), items_of(spark, range(4)), [1, 2, 3],
    ).collect()
    assert {r["k"]: r["recall"] for r in rows} == {1: 0.0, 2: 0.5, 3: 1.0}
    assert {r["k"]: r["coverage"] for r in rows} == {1: 0.25, 2: 0.5, 3: 0.75}


def test_no_evaluated_user_is_an_error(spark):
    with pytest.raises(ValueError, match="no evaluated user"):
        metrics.evaluate(
            recs_of(spark, {0: [1]}), pairs_frame(spark, [(5, 2)]), users_of(spark, [0]),
            items_of(spark, [1]), [1],
        )


def test_truth_is_warm_start_and_novel(spark):
    log = log_of(spark, [(0, 10, 1, 1), (0, 11, 2, 1), (0, 99, 3, 1), (1, 12, 4, 0)])
    truth = pairs.ground_truth(
        log, items=items_of(spark, [10, 11, 12]), seen=pairs_frame(spark, [(0, 10)])
    )
    assert [tuple(row) for row in truth.collect()] == [(0, 11)]
    assert pairs.ground_truth(log).count() == 3


def test_nan_labels_and_null_ids_are_not_positive(spark):
    rows = [(1, 1, float("nan")), (1, 2, 1.0), (None, 3, 1.0), (2, None, 1.0), (2, 4, 0.0)]
    log = spark.createDataFrame(rows, "user_id bigint, item_id bigint, like double")
    assert [tuple(r) for r in pairs.positive_pairs(log, "like").collect()] == [(1, 2)]


def test_segment_rows_equal_counting(spark):
    rng = random.Random(21)
    k, catalog = 4, range(15)
    lists = {user: rng.sample(catalog, 6) for user in range(12)}
    truth = {user: set(rng.sample(catalog, rng.randint(1, 5))) for user in range(12)}
    user_group = {user: rng.choice(["low", "high"]) for user in range(9)}  # the others have no positives
    item_group = {item: rng.choice(["head", "mid", "tail"]) for item in catalog}
    recs, users = recs_of(spark, lists), users_of(spark, lists)
    true = pairs_frame(spark, [(user, item) for user, items in truth.items() for item in items])

    def scores(shown, relevant):
        hits = [item in relevant for item in shown]
        ideal = sum(1 / math.log2(rank + 2) for rank in range(min(len(relevant), k)))
        gain = sum(hit / math.log2(rank + 2) for rank, hit in enumerate(hits))
        return sum(hits) / len(relevant), float(any(hits)), gain / ideal

    def mean(rows):
        return [sum(column) / len(rows) for column in zip(*rows)]

    by_user = spark.createDataFrame(list(user_group.items()), "user_id bigint, segment string")
    found = segments.evaluate_user_segments(recs, true, users, by_user, items_of(spark, catalog), k).collect()
    groups = {user: user_group.get(user, "zero_positive") for user in lists}
    assert {row["segment"] for row in found} == set(groups.values())
    for row in found:
        own = [user for user in lists if groups[user] == row["segment"]]
        want = mean([scores(lists[user][:k], truth[user]) for user in own])
        want.append(len({item for user in own for item in lists[user][:k]}) / 15)
        assert [row[name] for name in (*metrics.METRICS, "coverage")] == pytest.approx(want)
        assert row["evaluated_users"] == len(own)

    by_item = spark.createDataFrame(list(item_group.items()), "item_id bigint, segment string")
    found = segments.evaluate_item_segments(recs, true, users, by_item, k).collect()
    slots = [item for user in lists for item in lists[user][:k]]
    assert {row["segment"] for row in found} == {item_group[item] for items in truth.values() for item in items}
    for row in found:
        inside = {item for item in catalog if item_group[item] == row["segment"]}
        own = [user for user in lists if truth[user] & inside]
        want = mean([scores(lists[user][:k], truth[user] & inside) for user in own])
        want += [sum(item in inside for item in slots) / len(slots), len(inside & set(slots)) / len(inside)]
        names = (*metrics.METRICS, "recommendation_share", "group_coverage")
        assert [row[name] for name in names] == pytest.approx(want)
        assert (row["evaluated_users"], row["catalog_items"]) == (len(own), len(inside))


def test_cutoffs_interpolate(spark):
    rows = [(0, i, i, 1) for i in range(1)] + [(1, i, i, 1) for i in range(3)] + [
        (2, i, i, 1) for i in range(4)
    ]
    seen = pairs.positive_pairs(log_of(spark, rows))
    assert segments.activity_cuts(seen) == pytest.approx([1 + 4 / 3, 3 + 1 / 3])
    popularity = pairs.item_popularity(seen, items_of(spark, [0, 1, 2, 3, 9]))
    assert segments.popularity_cuts(popularity) == pytest.approx([2.0, 2.2])


def test_toy_users_and_sample(spark):
    splits = toy_splits(spark)
    truth = pairs.ground_truth(splits.validation)
    assert pairs.sample_users(truth, None, 1).count() == 4
    first = [r[0] for r in pairs.sample_users(truth, 2, 1).collect()]
    assert len(first) == 2 and first == [r[0] for r in pairs.sample_users(truth.repartition(3), 2, 1).collect()]
