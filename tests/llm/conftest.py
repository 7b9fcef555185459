import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, lang_pred string, domain string, rest long, codes string, set_id long, n string, "
    "heads string, list int, start long, epoch int, `odd name.x` string"
)
EXTRA = (0.5, "xx", "d", 7, "c", 9, "n", "h", 3, 1, 2, "z")


def word(draw: random.Random) -> str:
    return "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7)))


def text_of(draw: random.Random, count: int) -> str:
    return " ".join(word(draw) for _ in range(count))


def rows_of(spark, rows):
    """Documents (id, text, lang, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*row, len(row[1] or ""), *EXTRA) for row in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank, odd and long texts, ties, repeated rows, near copies."""
    draw = random.Random(4)
    base = text_of(draw, 120)
    near = base.split()
    near[40] = "changed"
    passage = text_of(draw, 60)
    long = text_of(draw, 30_000)
    return [
        (1, base, "en", "src1"), (2, base, "en", "src2"), (3, " ".join(near), "en", "src3"),
        (3, " ".join(near), "en", "src3"), (4, None, "en", "src0"), (5, "", None, "src0"), (6, " \t\n", "de", None),
        (None, base, "fr", "src4"), (7, "one", "en", "src5"), (8, "ONE", "en", "src5"), (9, "one two three", "de", "x"),
        (10, text_of(draw, 40) + " " + passage, "de", "src6"), (11, passage + "\n" + text_of(draw, 33), "es", "src7"),
        (12, long, "es", "src0"), (13, "naïve “quotes” 日本語 12345 !!! é", "fr", "src0"),
        (14, text_of(draw, 200).upper(), "en", "src1"), (14, text_of(draw, 5), "en", "src1"), (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return rows_of(spark, edge_rows)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return rows_of(spark, [])


@pytest.fixture(scope="session")
def many_rows():
    """Documents in groups of near copies, with shared passages and one large group of copies."""
    draw = random.Random(9)
    rows, passage = [], text_of(draw, 70).split()
    for group in range(40):
        base = text_of(draw, draw.randint(4, 150)).split()
        for _ in range(draw.randint(1, 6)):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = word(draw)
            if draw.random() < 0.3:
                own[draw.randrange(len(own)) : 0] = passage
            if draw.random() < 0.3:
                own = own[: -draw.randint(1, 12)] or own
            rows.append((len(rows), " ".join(own), draw.choice(["en", "de", "fr"]), f"src{group % 7}"))
    hot = text_of(draw, 90).split()
    for _ in range(120):
        own = list(hot)
        own[draw.randrange(len(own))] = word(draw)
        rows.append((len(rows), " ".join(own), "en", "src0"))
    rows += [(len(rows) + k, " ".join(hot), "en", "src0") for k in range(60)]
    draw.shuffle(rows)
    return rows
