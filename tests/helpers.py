"""Small logs and brute-force answers."""

import random

LOG = "user_id bigint, item_id bigint, event_time bigint, label int, tie bigint"


def log_of(spark, rows):
    """A log from (user, item, time, label) rows; the tie is the row number."""
    return spark.createDataFrame([(*row, at) for at, row in enumerate(rows)], LOG)


# The toy rows that the expected results of the tests rest on.
TOY_TRAIN = [
    (0, 10, 1, 1), (0, 11, 2, 1), (0, 12, 3, 0),
    (1, 10, 4, 1), (1, 11, 5, 1), (1, 13, 6, 0),
    (2, 12, 7, 1), (2, 13, 8, 1), (2, 10, 9, 0),
    (3, 12, 10, 1), (3, 13, 11, 1), (3, 11, 12, 0),
]
TOY_VALIDATION = [(0, 13, 20, 1), (1, 12, 21, 1), (2, 11, 22, 1), (3, 10, 23, 1)]
TOY_TEST = [(0, 13, 30, 1), (1, 12, 31, 1), (2, 11, 32, 1), (3, 10, 33, 1)]


def toy_splits(spark):
    from tastegrid.operators.splits import Splits

    train, validation, test = (
        log_of(spark, rows) for rows in (TOY_TRAIN, TOY_VALIDATION, TOY_TEST)
    )
    return Splits(train, validation, test, test)


def random_pairs(n_users, n_items, share, seed, heavy=()):
    """Distinct pairs; users in `heavy` have nearly every item."""
    rng = random.Random(seed)
    return [
        (user, item)
        for user in range(n_users)
        for item in range(n_items)
        if rng.random() < (0.9 if user in heavy else share)
    ]


def pairs_frame(spark, pairs):
    return spark.createDataFrame(pairs, "user_id bigint, item_id bigint")


def lists(frame, column="item_id"):
    """{user: items in rank order}"""
    found = {}
    for row in frame.orderBy("user_id", "rank").collect():
        found.setdefault(row["user_id"], []).append(row[column])
    return found


def planted_log(spark, n_users=200, n_items=100, per_user=24):
    """Two communities; 90% of a user's items come from the own half."""
    rng = random.Random(7)
    half = n_items // 2
    train, later = [], []
    for user in range(n_users):
        own = user % 2
        chosen = set()
        while len(chosen) < per_user:
            side = own if rng.random() < 0.9 else 1 - own
            chosen.add(side * half + rng.randrange(half))
        ordered = sorted(chosen, key=lambda _: rng.random())
        train += [(user, item, at, 1) for at, item in enumerate(ordered[:-6])]
        later += [(user, item, 1000 + at, 1) for at, item in enumerate(ordered[-6:])]
    return log_of(spark, train), log_of(spark, later)
