"""Spelling variants: words that differ by one character, found by pivotal grams.

The bigrams of a word are put in one order for all words, the rarer first. Its
prefix is the first three of them (and those equal to the third); its pivots
are two bigrams of the prefix that don't overlap, chosen by dynamic programming
so that they are rarest in sum. One edit spoils one pivot at most. So of two
near words, the one whose prefix ends earlier in the order has a pivot that is
in the other's prefix, moved by one place at most. One edit also leaves one
half of a word as it is, so a pivot is looked up together with the half that
would have to be the same. What is found is compared by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import materialize, release, temporary
from tastegrid.session import materialize as keep

RUN = "[A-Za-zÀ-ÿ]"
#: One in so many occurrences loses a character.
SPOILED = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form has at least so many times the occurrences of the word.
TIMES = 10
#: Distinct words that a task counts before it gives them out.
_COUNTED = 200_000
_PREFIX = 3
_LOWER = {k: k + 32 for k in range(65, 91)}
_MAX_ROUNDS = 64


def spoiled(doc_id: int | None, run: str, every: int = SPOILED) -> str:
    """A run of letters in lower case, without a character where the hash says so."""
    code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if code % every:
        return run
    place = code % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Rows of word and n, its occurrences, for words of at least `least` characters.

    Null texts have none; a null id is hashed as an empty one.
    """
    runs = re.compile(f"{RUN}{{{least},}}")

    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = Counter(one.translate(_LOWER) for one in runs.findall(own.as_py() or ""))
                for one, n in found.items():
                    one = spoiled(doc_id, one)
                    if len(one) >= least:
                        words[one] += n
                if len(words) >= _COUNTED:
                    yield counted(words)
                    words = Counter()
            release()
        yield counted(words)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order, by the number of words' places that have it.

    There are at most 90 letters after folding, so 8,100 bigrams, at any size of input.
    """
    grams = F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, k, 2))")
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {row["gram"]: place for place, row in enumerate(sorted(counts, key=lambda row: (row["n"], row["gram"])))}


def prefix_of(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """Rank and place of the rarest bigrams, with all that are equal to the last."""
    grams = sorted((ranks[word[k : k + 2]], k) for k in range(len(word) - 1))
    last = grams[min(_PREFIX, len(grams)) - 1][0]
    beyond = _PREFIX
    while beyond < len(grams) and grams[beyond][0] == last:
        beyond += 1
    return grams[:beyond]


def pivots_of(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The two bigrams of a prefix that don't overlap and whose ranks are least in sum.

    By place, the best choice that ends at a bigram is this one with the best
    single one that ends at least two places before it.
    """
    best: tuple[int, list[tuple[int, int]]] | None = None
    single: tuple[int, int] | None = None  # the best one up to two places before
    waiting: list[tuple[int, int]] = []
    for rank, place in sorted(prefix, key=lambda gram: gram[1]):
        while waiting and waiting[0][1] <= place - 2:
            gram = waiting.pop(0)
            single = gram if single is None else min(single, gram)
        if single is not None and (best is None or single[0] + rank < best[0]):
            best = single[0] + rank, [single, (rank, place)]
        waiting.append((rank, place))
    return best[1] if best else []


def _halves(length: int) -> tuple[int, int]:
    """Characters of a word's left and right half."""
    return length // 2, length - length // 2


def _code(rank: int, side: str, half: str) -> int:
    """A 64-bit hash of a gram and a half of a word."""
    high, low = zlib.crc32(half.encode()), zlib.crc32(f"{side}{rank}:{half[::-1]}".encode())
    return (high << 32 | low) - (1 << 63)


def _lookups(word: str, prefix: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Code and places of the pivots, each with either half of the word."""
    left, right = _halves(len(word))
    for rank, place in pivots_of(prefix):
        yield _code(rank, "l", word[:left]), place, place
        yield _code(rank, "r", word[len(word) - right :]), place, place


def _index(word: str, prefix: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Code, first and last place of the prefix's grams, with the halves of near words.

    These are the halves that a word of a character less, as many or one more
    would have in common with this one. The rows of a word are bounded.
    """
    size = len(word)
    near = [_halves(other) for other in (size - 1, size, size + 1)]
    sides = {("l", word[:left]) for left, _ in near} | {("r", word[size - right :]) for _, right in near}
    places: dict[int, list[int]] = {}
    for rank, place in prefix:
        places.setdefault(rank, []).append(place)
    for rank, own in places.items():
        for side, half in sides:
            yield _code(rank, side, half), own[0], own[-1]


def entries(words: DataFrame, ranks: dict[str, int], lookups: bool) -> DataFrame:
    """The lookups of pivots or the index of prefixes.

    Rows have code, which stands for a gram and a half, word, n, the rank that
    ends the prefix, and the first and last place of the gram.
    """
    broadcast = words.sparkSession.sparkContext.broadcast(ranks)
    made = _lookups if lookups else _index
    names = ["word", "n", "last", "code", "first", "final"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = broadcast.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                prefix = prefix_of(word, order)
                rows += [(word, n, prefix[-1][0], *entry) for entry in made(word, prefix)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return words.mapInArrow(run, "word string, n long, last int, code long, first int, final int")


def near_words(words: DataFrame) -> DataFrame:
    """Rows of word, n, other and n_other, both ways, for words one character apart."""
    ranks = gram_ranks(words)
    left, right = entries(words, ranks, True).alias("l"), entries(words, ranks, False).alias("r")
    met = left.join(
        right,
        (F.col("l.code") == F.col("r.code"))
        & (F.col("l.last") <= F.col("r.last"))
        & (F.abs(F.length("l.word") - F.length("r.word")) <= 1)
        & F.col("l.first").between(F.col("r.first") - 1, F.col("r.final") + 1)
        & (F.col("l.word") != F.col("r.word"))
        & (F.levenshtein("l.word", "r.word", 1) == 1),
    )
    first = F.col("l.word") < F.col("r.word")
    pairs = met.select(
        F.when(first, F.col("l.word")).otherwise(F.col("r.word")).alias("word"),
        F.when(first, F.col("l.n")).otherwise(F.col("r.n")).alias("n"),
        F.when(first, F.col("r.word")).otherwise(F.col("l.word")).alias("other"),
        F.when(first, F.col("r.n")).otherwise(F.col("l.n")).alias("n_other"),
    ).distinct()
    way = F.array(
        F.struct("word", "n", "other", "n_other"),
        F.struct(F.col("other").alias("word"), F.col("n_other").alias("n"), F.col("word").alias("other"), F.col("n").alias("n_other")),
    )
    return pairs.select(F.inline(way))


def roots(forms: DataFrame) -> DataFrame:
    """Rows of word and root for rows of word and form, following forms to the last.

    Each round follows as many forms as all rounds before it, so a chain of any
    length takes the logarithm of it.
    """
    found = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(_MAX_ROUNDS):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = materialize(found.join(further, "root", "left"))
        if followed.where("next IS NOT NULL").isEmpty():
            return found
        found = materialize(followed.select("word", F.coalesce("next", "root").alias("root")))
    raise RuntimeError(f"forms did not settle in {_MAX_ROUNDS} rounds")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of word, form, root, n, n_near and form_n, one per word.

    Words are the distinct results of `spoiled` on runs of letters, with at
    least LEAST_LENGTH characters and LEAST_COUNT occurrences. Two are near if
    one edit makes one of the other. The form is the near word that occurs most
    (ties: smallest), if it has TIMES as many occurrences; root is the last
    form of a chain of them, or the word. Every row of `docs` counts, also those
    that repeat an id or have none; no text, no words.
    """
    with temporary(docs.sparkSession):
        words = materialize(word_counts(docs, key, text).where(F.col("n") >= LEAST_COUNT))
        near = near_words(words).groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best")
        )
        near = materialize(near)
        enough = F.col("n") * TIMES <= -F.col("best.less")
        formed = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
        formed = materialize(formed)
        last = roots(formed.where("form IS NOT NULL"))
        done = formed.join(last, "word", "left")
        return keep(done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
