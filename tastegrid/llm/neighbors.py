"""Approximate nearest neighbours by cosine with an adaptive dimension scan.

Unit vectors are turned by a random rotation, so that any columns are a random
sample of all dimensions, and put into the list of their nearest centroid. A
query scans its own list first; the k-th best there is its bound. It then
probes the lists whose cone (angle to the centroid, largest angle of a member)
may hold something nearer. Within a list, distances grow column block by column
block, and after each block a candidate is abandoned if its distance estimated
from the columns seen exceeds the bound by more than the test allows. What is
left is scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.frames import bounded_sample
from tastegrid.session import materialize

K = 5
LISTS = 64
SAMPLE = 16_384
COLUMNS = 16
#: Width of the hypothesis test: larger abandons later and misses less.
WIDTH = 2.5
BLOCK = 4_096
QUERIES = 2_048
_CHUNK = 512


@dataclass
class VectorIndex:
    """Rotation, centroids and each list's largest angle to its centroid."""

    rotation: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of vec_id and v (doubles) that take part, one per vec_id.

    Left out are null ids and vectors that are null, empty or zero or hold
    null or non-finite components, and vectors not of the most frequent length
    (the smallest of equally frequent ones). Of rows with one id the smallest
    vector counts.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count()
    width = sizes.orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("v") == (width["size"] if width else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 3) -> VectorIndex | None:
    """Centroids by spherical k-means over about `sample` vectors; None without vectors."""
    drawn = bounded_sample(rows, F.col("vec_id"), sample).select("vec_id", "v").toPandas().sort_values("vec_id")
    if not len(drawn):
        return None
    points, draw = _unit(np.vstack(drawn["v"].to_list())), np.random.default_rng(seed)
    rotation, upper = np.linalg.qr(draw.normal(size=(points.shape[1],) * 2))
    rotation *= np.sign(np.diag(upper))
    centroids = points[draw.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(12):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centroids)
    return VectorIndex(rotation, np.unique(centroids, axis=0), np.zeros(0))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _assign(rows: DataFrame, index: VectorIndex) -> DataFrame:
    """Rows with their list and angle to its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _unit(_matrix(batch.column("v"))) @ shared.value.centroids.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(cosines.argmax(axis=1).astype(np.int32)),
                     pa.array(_angles(cosines.max(axis=1)))],
                    ["vec_id", "v", "list", "angle"],
                )

    return rows.mapInArrow(run, "vec_id long, v array<double>, list int, angle double")


class Scan:
    """One block of candidates, rotated, with running best results per query."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.lengths = np.sqrt((rows * rows).sum(axis=1))
        self.turned = _unit(rows) @ rotation
        self.rotation = rotation
        self.scored = 0

    def _score(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        length = np.sqrt((query * query).sum())
        return (self.rows[places] * query).sum(axis=1) / (self.lengths[places] * length)

    def nearest(self, query_id: int, query: np.ndarray, bound: float, k: int) -> list[tuple[float, int]]:
        """Up to k (score, id), best first, ties to the smaller id."""
        turned = _unit(query[None, :])[0] @ self.rotation
        size = len(turned)
        best: list[tuple[float, int]] = []
        for start in range(0, len(self.ids), _CHUNK):
            block = self.turned[start : start + _CHUNK]
            alive = np.arange(len(block))
            limit = 2 - 2 * bound + 1e-9 if bound > -1 else np.inf
            seen = np.zeros(len(block))
            for column in range(0, size, COLUMNS):
                part = slice(column, min(column + COLUMNS, size))
                own = block[alive, part] if column else block[:, part]
                seen = seen + ((own - turned[part]) ** 2).sum(axis=1)
                done = part.stop
                slack = 1.0 if done == size else (1 + WIDTH / np.sqrt(done)) ** 2
                kept = seen * (size / done) <= limit * slack
                alive, seen = alive[kept], seen[kept]
                if not len(alive):
                    break
            alive = alive[self.ids[start + alive] != query_id] + start
            if len(alive):
                self.scored += len(alive)
                scores = self._score(query, alive)
                found = [*best, *zip(scores.tolist(), self.ids[alive].tolist())]
                best = sorted(found, key=lambda pair: (-pair[0], pair[1]))[:k]
                if len(best) == k:
                    bound = max(bound, best[-1][0])
        return best


def _search(base: DataFrame, probes: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Per probe the k best of a block. base: list, block, vec_id, v; probes: list, block, vec_id, v, bound."""
    shared = base.sparkSession.sparkContext.broadcast(index.rotation)
    counts = probes.groupBy("list", "block").agg(F.count("*").alias("n"))
    parts = counts.select("list", "block", F.expr(f"cast((n - 1) div {QUERIES} + 1 as int)").alias("parts"))
    asked = probes.join(parts, ["list", "block"]).select(
        "list", "block", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "vec_id", "v", "bound",
    )
    held = base.join(parts, ["list", "block"]).select(
        "list", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "vec_id", "v",
        F.lit(0.0).alias("bound"),
    )
    group = ["list", "block", "part"]
    rows = held.unionByName(asked).repartition(*group).sortWithinPartitions(*group, "role", "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, None
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(name).to_numpy() for name in (*group, "role")], axis=1)
            vec, matrix, bounds = batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), batch.column("bound").to_numpy()
            cuts = np.append(0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1)
            found: list[tuple[int, int, float]] = []
            for first, last in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                name, role = tuple(names[first, :3]), names[first, 3]
                if name != now:
                    now, scan, ids, held = name, None, [], []
                if role == 0:
                    ids.append(vec[first:last])
                    held.append(matrix[first:last])
                    continue
                if scan is None and ids:
                    scan = Scan(np.concatenate(ids), np.vstack(held), shared.value)
                    ids, held = [], []
                for place in range(first, last) if scan is not None else ():
                    best = scan.nearest(vec[place], matrix[place], bounds[place], k)
                    found.extend((vec[place], other, score) for score, other in best)
            columns = zip(*found) if found else ((), (), ())
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, index: VectorIndex, k: int = K) -> DataFrame:
    """Rows of query_id, rank, vec_id and score for each query of `queries` among `rows`.

    Both hold vec_id and v as `usable` gives them. A query's own id is no
    candidate; with fewer than k candidates all that the lists give are
    returned. Of equal vectors only the k + 1 smallest ids can be among the k
    nearest, so only those are searched. Lists are searched in blocks.
    """
    spark = rows.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    base = materialize(_assign(kept, index))
    lists = base.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    sizes = lists.select("list", "reach", F.expr(f"cast((n - 1) div {BLOCK} + 1 as int)").alias("blocks"))
    sizes = materialize(sizes)  # at most LISTS rows
    base = base.join(F.broadcast(sizes.select("list", "blocks")), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v"
    )
    asked = materialize(_assign(queries, index).select("vec_id", "v", "list"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    known = F.broadcast(sizes)
    own = asked.join(known, "list").select("list", every, "vec_id", "v", F.lit(-1.0).alias("bound"))
    first = materialize(_ranked(_search(base, own, index, k), k))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    reach = np.full(len(index.centroids), -1.0)
    for row in sizes.collect():
        reach[row["list"]] = row["reach"]
    shared = spark.sparkContext.broadcast(VectorIndex(index.rotation, index.centroids, reach))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                known, bound = shared.value, piece.column("bound").to_numpy()
                angles = _angles(_unit(_matrix(piece.column("v"))) @ known.centroids.T)
                near = np.maximum(angles - known.reach - 1e-7, 0)
                wanted = (np.cos(np.minimum(near, np.pi)) >= bound[:, None] - 1e-9) & (known.reach >= 0)
                wanted[np.arange(len(bound)), piece.column("list").to_numpy()] = False
                at, lists = np.nonzero(wanted)
                taken = piece.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), taken.column("vec_id"), taken.column("v"), taken.column("bound")],
                    ["list", "vec_id", "v", "bound"],
                )

    rest = asked.join(bounds, "vec_id", "left").select("vec_id", "v", "list", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
    rest = rest.mapInArrow(probe, "list int, vec_id long, v array<double>, bound double")
    rest = rest.join(known, "list").select("list", every, "vec_id", "v", "bound")
    second = _search(base, rest, index, k)
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(second), k)
