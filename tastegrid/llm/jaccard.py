"""N-gram Jaccard join by T-occurrence search over inverted lists.

Two texts link when their sets of word shingles reach a Jaccard similarity.
Then each holds at least the needed share of the other's set, so of any order
of the shingles that all sets share, the first few of one (one more than it may
lack) hold one that is in the other. The order here is rarity: documents give
out their shingles below a fixed hash value (and as many as they may lack, if
those are few), shingles seen once come first and link nothing, and the rarest
of the others become the document's keys. What has keys then gives out all its
shingles, which are counted anew among these documents, so that only a document
that really shares enough of them keeps keys. Documents under one key form a list.

Lists are searched as DivideSkip does: a query needs T common shingles; the
longest of its inverted lists are set aside, the short ones are merged, what
occurs T minus that number of times is looked up in the long ones by binary
search, and documents reaching the overlap stay.

Equal sets are one class. Lists with the same smallest class, their leader, are
one group. Each class is first compared with a few members of one group only,
and the classes so linked become components. In the groups that still hold
several components, all members outside the largest one are queries against all
members, in blocks bounded by the shingles they hold. So a large group of near copies is not compared pair by
pair, and no link that would join two components is lost. A task leaves out
links inside what it has joined already, so it gives out fewer links than it
has components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.components import components
from tastegrid.llm.frames import add_columns, columns_of, drop_table, few, materialize, pieces, release, temporary
from tastegrid.llm.text import mixed, shingles, words
from tastegrid.session import materialize as keep

WORDS = 4
PERCENT = 85
#: Share of all hash values below which shingles are given out first, as a multiple of the share a set may lack.
SAMPLED = 1.3
#: Members of a list that are searched at a time, and how many such blocks one after another.
BLOCK = 256
RUN = 16
#: Shingles of a member up to which a block takes more members, in place of longer ones.
MEMBER_CODES = 2048
#: Members of each group that the others are compared with first.
LEADERS = 16


def needed(size, percent: int):
    """Shingles that a linked set shares at least with a set of `size`."""
    return -(-percent * size // 100)


def set_code(codes: np.ndarray) -> int:
    """A 64-bit hash of a set of shingle codes."""
    with np.errstate(over="ignore"):
        total = mixed(codes).sum(dtype=np.uint64) * np.uint64(2) + np.uint64(len(codes))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in pieces(batch, ["text"]):
            cut = words(piece.column("text"))
            yield piece, [shingles(cut.code[a:b], length) for a, b in zip(cut.of[:-1], cut.of[1:])]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sketches(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Rows of doc_id, n_shingles, set_id and the shingles given out."""
    limit = np.uint64(min(int(SAMPLED * (100 - percent) / 100 * 2**64), 2**64 - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _sets(batches, length):
            kept = [own[: max(int(np.searchsorted(own, limit)), len(own) - needed(len(own), percent) + 1)] for own in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array([len(own) for own in sets], pa.int32()),
                    pa.array([set_code(own) for own in sets], pa.int64()), _lists(kept),
                ],
                ["doc_id", "n_shingles", "set_id", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles int, set_id long, sketch array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Rows of set_id and codes for the classes in `wanted` (set_id, doc_id of one member)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, length):
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_code(own) for own in sets], pa.int64()), _lists(sets)], ["set_id", "codes"]
            )

    def sets_of(rows: DataFrame) -> DataFrame:
        found = rows.select("text").mapInArrow(run, "set_id long, codes array<long>")
        return found.join(wanted.select("set_id"), "set_id", "left_semi")

    ids = few(wanted.select("doc_id").distinct())
    chosen = docs.join(ids, "doc_id", "left_semi")
    again = materialize(chosen.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():  # one row for each class
        return sets_of(chosen)
    again = few(again)
    once = sets_of(chosen.join(again, "doc_id", "left_anti"))
    return once.unionByName(sets_of(chosen.join(again, "doc_id", "left_semi"))).dropDuplicates(["set_id"])


class InvertedIndex:
    """Lists of the sets that hold each code, in rising order of the sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(own) for own in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.codes, starts = np.unique(flat[order], return_index=True)
        self.owner, self.ends = owner[order], np.append(starts, len(flat))

    def search(self, query: np.ndarray, percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """The sets linked with `query`, by DivideSkip; of those marked in `wanted` if given."""
        if not len(query) or not len(self.codes):
            return np.zeros(0, np.int64)
        least = int(needed(len(query), percent))
        place = np.minimum(np.searchsorted(self.codes, query), len(self.codes) - 1)
        place = place[self.codes[place] == query]
        if len(place) < least:
            return np.zeros(0, np.int64)
        lengths = self.ends[place + 1] - self.ends[place]
        place = place[np.argsort(lengths, kind="stable")]
        aside = min(least - 1, int(least / (0.01 * np.log2(lengths.max() + 1) + 1)))
        short, long = place[: len(place) - aside], place[len(place) - aside :]
        merged = np.concatenate([self.owner[self.ends[k] : self.ends[k + 1]] for k in short])
        merged, counts = np.unique(merged, return_counts=True)
        enough = counts >= least - aside
        if wanted is not None:
            enough &= wanted[merged]
        found, counts = merged[enough], counts[enough]
        for done, k in enumerate(long):
            held = self.owner[self.ends[k] : self.ends[k + 1]]
            at = np.minimum(np.searchsorted(held, found), len(held) - 1)
            counts = counts + (held[at] == found)
            alive = counts >= least - (aside - done - 1)
            found, counts = found[alive], counts[alive]
        linked = 100 * counts >= percent * (len(query) + self.sizes[found] - counts)
        return found[linked]


def _search_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links a-b between the queries and the indexed sets of each group.

    `rows` holds g1, g2, g3 (the group), role (1: query, 2: indexed, 3: both),
    component, set_id and codes. A link is left out if links given out before
    by the same task join its components.
    """
    group = ["g1", "g2", "g3"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, joined = None, [], Joined()
        found: list[tuple[int, int]] = []
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*group, "role", "component")}
            codes = batch.column("codes")
            ends, flat = codes.offsets.to_numpy(), codes.values.to_numpy()
            for row in range(batch.num_rows):
                name = tuple(columns[part][row] for part in group)
                if name != now:
                    found += _links(members, joined, percent)
                    now, members = name, []
                members.append((int(columns["role"][row]), int(columns["component"][row]), flat[ends[row] : ends[row + 1]].copy()))
            if found:
                yield _edges(found)
                found = []
            release()
        found += _links(members, joined, percent)
        yield _edges(found)
        members.clear()
        release()

    # a task gets some blocks with the same queries, so that it sees what is joined already
    part = F.floor(F.col("g3") / RUN)
    ordered = rows.repartition("g1", "g2", part).sortWithinPartitions(*group)
    return ordered.select(*group, "role", "component", "codes").mapInArrow(run, "a long, b long").distinct()


class Joined:
    """Components and which of them are known to be one."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        path = []
        while (above := self.parent.get(node, node)) != node:
            path.append(node)
            node = above
        for one in path:
            self.parent[one] = node
        return node


def _links(members: list[tuple[int, int, np.ndarray]], joined: Joined, percent: int) -> Iterator[tuple[int, int]]:
    """Links of a group that join what isn't joined."""
    indexed = [row for row in members if row[0] & 2]
    roots = np.array([joined.root(component) for _, component, _ in indexed], np.int64)
    index = None
    for role, component, codes in members:
        if not role & 1:
            continue
        own = joined.root(component)
        others = roots != own
        if not others.any():
            continue
        index = index or InvertedIndex([row[2] for row in indexed])
        for other in np.unique(roots[index.search(codes, percent, others)]).tolist():
            yield component, other
            joined.parent[other] = own
            roots[roots == other] = own


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    """Rows of code and set_id: the rarest shingles that a class must share one of."""
    given = classes.select("set_id", F.explode("sketch").alias("code"))
    # written, so that the join deals rows out anew and can split a code that very many classes hold
    often = materialize(given.groupBy("code").agg(F.count("*").alias("n")).where("n > 1"))
    met = given.join(often, "code").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("met"))
    sized = classes.select("set_id", F.col("n_shingles").cast("long").alias("size"), F.size("sketch").alias("given"))
    # shingles it may lack and one more, less those seen nowhere else
    open_ = F.expr(f"size + 1 - (({percent} * size + 99) div 100) - (given - size(met))").cast("int")
    return (
        sized.join(met, "set_id").withColumn("open", open_).where("open > 0")
        .select("set_id", F.explode(F.slice("met", F.lit(1), F.col("open"))).alias("x"))
        .select("set_id", "x.code")
    )


def _led(keys: DataFrame) -> DataFrame:
    """Rows of leader, set_id and n: the classes of all lists with that smallest class, and shared keys.

    Two classes under one key are under that list's leader together, and lists
    of one group of texts have few leaders, so a class is searched a few times
    rather than once per key.
    """
    leaders = keys.groupBy("code").agg(F.min("set_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return keys.join(leaders.select("code", "leader"), "code").groupBy("leader", "set_id").agg(F.count("*").alias("n"))


def _first_links(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each class with about LEADERS members of the group that it shares most keys with."""
    shared = led.where("set_id <> leader")
    best = shared.groupBy("set_id").agg(F.min_by("leader", F.struct(-F.col("n"), F.col("leader"))).alias("leader"))
    best = materialize(best)
    counts = best.groupBy("leader").agg(F.count("*").alias("n"))
    blocks = counts.select("leader", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)").alias("blocks"))
    sized = best.join(counts, "leader").join(blocks, "leader")
    # about LEADERS of them, all if there are no more
    chosen = F.pmod(F.xxhash64("set_id", F.lit(LEADERS)), "n") < LEADERS
    members = sized.select(
        F.col("leader").alias("g1"), F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("g2"),
        F.when(chosen & (F.col("blocks") == 1), 3).otherwise(2).alias("role"), "set_id",
    )
    elsewhere = sized.where(chosen & (F.col("blocks") > 1)).select("leader", "set_id", "blocks")
    asked = elsewhere.unionByName(blocks.select("leader", F.col("leader").alias("set_id"), "blocks"))
    queries = asked.select(
        F.col("leader").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"), F.lit(1).alias("role"), "set_id",
    )
    rows = members.union(queries).join(sets, "set_id").withColumns({"g3": F.lit(0), "component": F.col("set_id")})
    return _search_groups(rows, percent)


def _blocks(n: str, codes: str) -> Column:
    """Blocks of `n` sets that hold `codes` shingles: of BLOCK sets, or of more sets if they are short."""
    return F.expr(f"cast(least(({n} - 1) div {BLOCK}, ({codes} - 1) div {BLOCK * MEMBER_CODES}) + 1 as int)")


def _later_links(led: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet under a leader."""
    placed = named.join(sets.select("set_id", "size"), "set_id")
    listed = materialize(led.select("leader", "set_id").join(placed, "set_id"))
    parts = listed.groupBy("leader", "component").agg(F.count("*").alias("n"), F.sum("size").alias("codes"))
    groups = parts.groupBy("leader").agg(
        F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("codes").alias("codes"),
        F.max(F.struct("n", "component", "codes")).alias("largest"),
    )
    sized = groups.where("components > 1").select(
        "leader", F.col("largest.component").alias("largest"), _blocks("n", "codes").alias("blocks"),
        _blocks("(n - largest.n)", "(codes - largest.codes)").alias("parts"),
    )
    rows = listed.join(sized, "leader").withColumn("outside", F.expr("component <> largest"))
    small = rows.where("blocks = 1").select(
        "set_id", "component", F.col("leader").alias("g1"), F.lit(0).alias("g2"), F.lit(0).alias("g3"),
        F.when(F.col("outside"), 3).otherwise(2).alias("role"),
    )
    large = rows.where("blocks > 1")
    place = F.pmod(F.xxhash64("set_id"), F.lit(1 << 30))
    queries = large.where("outside").select(
        "set_id", "component", F.col("leader").alias("g1"), (place % F.col("parts")).cast("int").alias("g2"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g3"), F.lit(1).alias("role"),
    )
    indexed = large.select(
        "set_id", "component", F.col("leader").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g2"),
        (place % F.col("blocks")).cast("int").alias("g3"), F.lit(2).alias("role"),
    )
    every = small.unionByName(queries).unionByName(indexed)
    return _search_groups(every.join(sets.select("set_id", "codes"), "set_id"), percent)


def join_groups(docs: DataFrame, key: str = "doc_id", length: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of doc_id, n_shingles and component_id, one per row of `docs`.

    component_id is the smallest id reachable over links. Texts with fewer
    words than `length` have their whole sequence as one shingle; null, empty
    and blank texts have none and link with nothing. Equal sets link whatever
    their size. Rows that repeat an id are rows of their own; null ids link
    others but a component takes its name from ids that aren't null.
    """
    return _grouped(docs, key, length, percent).drop("set_id")


def _grouped(docs: DataFrame, key: str, length: int, percent: int) -> DataFrame:
    """Rows of doc_id, set_id, n_shingles and component_id, one per row of `docs`."""
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    with temporary(docs.sparkSession):
        found = sketches(frame, length, percent)
        classes = found.where("n_shingles > 0").groupBy("set_id").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        )
        whole = materialize(classes)
        first_keys = _keys(whole, percent).select("set_id").distinct()
        classes = materialize(whole.select("set_id", "doc_id"))
        wanted = materialize(first_keys.join(classes, "set_id"))
        drop_table(whole)
        every = materialize(whole_sets(frame, wanted, length).withColumn("size", F.size("codes")))
        keys = materialize(_keys(every.toDF("set_id", "sketch", "n_shingles"), percent))
        # what shares less than it must with all others together is left out
        sets = materialize(every.join(few(keys.select("set_id").distinct()), "set_id", "left_semi"))
        drop_table(every)
        led = materialize(_led(keys))
        first = components(_first_links(led, sets, percent))
        named = keys.select("set_id").distinct().join(first.withColumnRenamed("node", "set_id"), "set_id", "left")
        named = materialize(named.select("set_id", F.coalesce("component", "set_id").alias("component")))
        later = components(_later_links(led, named, sets, percent))
        final = named.join(later.toDF("component", "top"), "component", "left").select(
            "set_id", F.coalesce("top", "component").alias("component")
        )
        rows = found.select("doc_id", "n_shingles", "set_id").join(_names(classes, final), "set_id", "left")
        own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return keep(
            rows.select("doc_id", "set_id", F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"))
        )


def _names(classes: DataFrame, final: DataFrame) -> DataFrame:
    """Each class with the smallest id of its component."""
    placed = classes.select("set_id", "doc_id").join(final, "set_id", "left")
    placed = placed.select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("set_id", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", length: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each component, the smallest id; columns stay as they are.

    Texts without words and rows with null ids stay. Rows that repeat id and
    text stay once; rows that share an id and differ in text are kept.
    """
    groups = _grouped(docs, key, length, percent)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key), "set_id").distinct()
    rest = dropped.select(key).distinct()
    kept = docs.join(few(rest), key, "left_anti").select(*columns_of(docs))
    parted = groups.groupBy("doc_id").agg(F.min(F.expr("doc_id <> component_id")).alias("all"), F.max(F.expr("doc_id <> component_id")).alias("any"))
    parted = parted.where("any AND NOT all").select(F.col("doc_id").alias(key))
    if not parted.isEmpty():  # ids of which some texts are dropped and others not
        kept = kept.unionByName(_other_sets(docs.join(few(parted), key, "left_semi").select(*columns_of(docs)), dropped, key, length))
    again = groups.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    repeated = again.select(F.col("doc_id").alias(key))
    once = kept.join(repeated, key, "left_semi").dropDuplicates([key, "text"]).select(*columns_of(docs))
    return kept.join(repeated, key, "left_anti").select(*columns_of(docs)).unionByName(once)


def _other_sets(docs: DataFrame, dropped: DataFrame, key: str, length: int) -> DataFrame:
    """The rows of `docs` whose id and set are not in `dropped`."""
    name = "set_id"
    while name.lower() in (column.lower() for column in docs.columns):
        name = f"_{name}"

    def coded(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        cut = words(arrays[0])
        return {name: pa.array([set_code(shingles(cut.code[a:b], length)) for a, b in zip(cut.of[:-1], cut.of[1:])], pa.int64())}

    marked = add_columns(docs, ["text"], coded, f"{name} long")
    return marked.join(dropped.withColumnRenamed("set_id", name), [key, name], "left_anti").select(*columns_of(docs))
