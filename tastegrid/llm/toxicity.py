"""Toxicity from the nearest labelled examples by TF-IDF cosine.

Terms are words and the first four and five letters of words. Of the terms of
a bounded labelled sample, those that go with one label are the vocabulary;
their document frequencies come from all documents. Examples are unit TF-IDF
vectors in an inverted index whose lists are cut into blocks of examples with
the largest weight of each. A query visits blocks in falling order of the sum of
these bounds and stops when no block can reach its k-th best cosine, so the
nearest examples are exact. Their labels vote, weighted by distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import add_columns, bounded_sample, pieces
from tastegrid.llm.text import mixed, words

EXAMPLES = 8_000
VOCABULARY = 4_096
#: Least chi-square of a vocabulary term, and least examples it occurs in.
LEAST_CHI = 30.0
LEAST_COUNT = 4
K = 15
BLOCK = 64
#: Votes for the share of toxic examples among those without terms.
PRIOR_VOTES = 0.5

_PARTING = np.ones(256, bool)
_PARTING[[*range(97, 123), *range(65, 91), *range(128, 256)]] = False
_PREFIXES = (4, 5)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term codes and their texts, one per word and prefix of each text."""
    cut = words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _PARTING)
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.of))
    letter = np.append(0, np.cumsum((cut.data & 0xC0) != 0x80))  # letters before each byte
    places = np.flatnonzero((cut.data & 0xC0) != 0x80)
    codes, owners = [cut.code], [owner]
    for size in _PREFIXES:
        long = np.flatnonzero(letter[cut.end] - letter[cut.begin] >= size)
        if not len(long):
            continue
        last = letter[cut.begin[long]] + size
        end = np.where(last < len(places), places[np.minimum(last, len(places) - 1)], len(cut.data))
        codes.append(_spans(cut.data, cut.begin[long], end, size))
        owners.append(owner[long])
    return np.concatenate(codes), np.concatenate(owners)


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Codes of short byte spans."""
    total = np.full(len(begin), salt, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(int((end - begin).max())):
            inside = begin + step < end
            byte = data[np.minimum(begin + step, len(data) - 1)].astype(np.uint64)
            total = np.where(inside, total * np.uint64(1099511628211) + byte + np.uint64(1), total)
    return mixed(total)


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with counts, ordered by text, then term."""
    codes, owners = terms(texts)
    order = np.lexsort((codes, owners))
    codes, owners = codes[order], owners[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return owners[first], codes[first], np.diff(np.append(first, len(codes)))


@dataclass
class ToxicityModel:
    """Vocabulary, its idf, the examples' labels and the blocked index.

    `lists` holds per block a dense matrix of examples x block terms; `tops`
    holds the largest weight of each term in each block.
    """

    codes: np.ndarray
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    tops: np.ndarray
    lists: list[tuple[np.ndarray, np.ndarray]]
    base: float

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Vocabulary places and unit weights of each text."""
        owner, codes, counts = _counts(texts)
        place = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == codes[inside]
        owner, place = owner[known], place[known]
        weight = (1 + np.log(counts[known])) * self.idf[place]
        norm = np.sqrt(np.bincount(owner, weight**2, minlength=len(texts)))
        weight = weight / np.where(norm[owner] > 0, norm[owner], 1)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [(place[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def search(self, place: np.ndarray, weight: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a cosine above 0, best first, ties to smaller ids."""
        if not len(place) or not len(self.tops):
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = self.tops[:, place] @ weight
        found, cosines, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(found) == k and bounds[block] < least - 1e-12):
                break
            own, matrix = self.lists[block]
            at = np.minimum(np.searchsorted(own, place), len(own) - 1)
            held = own[at] == place
            scores = matrix[:, at[held]] @ weight[held]
            rows = np.flatnonzero(scores > 0)
            found = np.append(found, block * BLOCK + rows)
            cosines = np.append(cosines, scores[rows])
            best = np.lexsort((self.ids[found], -np.round(cosines, 12)))[:k]
            found, cosines = found[best], cosines[best]
            if len(found) == k:
                least = cosines[-1]
        return found, cosines

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes, each cosine^2 / (1.05 - cosine), and the prior votes."""
        weights = cosines**2 / (1.05 - np.minimum(cosines, 1.0))
        return float((weights @ self.labels[found] + PRIOR_VOTES * self.base) / (weights.sum() + PRIOR_VOTES))


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows of doc_id, text and toxic; several labels of a document count as their largest."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known, F.col("doc_id"), bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `bound` rows


def _vocabulary(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Codes of the terms that go with a label most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        rows = np.zeros(2, np.int64)
        seen = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                owner, codes, _ = _counts(piece.column("text"))
                toxic = piece.column("toxic").to_numpy() == 1
                rows += (len(toxic) - toxic.sum(), toxic.sum())
                for label in (0, 1):
                    seen[label] = np.append(seen[label], codes[toxic[owner] == bool(label)])
        for label in (0, 1):
            codes, counts = np.unique(seen[label], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.view(np.int64)), pa.array(counts * (label == 0)), pa.array(counts * (label == 1)), pa.array(np.zeros(len(codes), bool))],
                ["code", "clean", "toxic", "total"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()), pa.array(rows[:1]), pa.array(rows[1:]), pa.array([True])], ["code", "clean", "toxic", "total"]
        )

    counted = sample.select("text", "toxic").mapInArrow(run, "code long, clean long, toxic long, total boolean")
    counted = counted.groupBy("total", "code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counted.where("total").agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    clean, toxic = float(totals[0]), float(totals[1])
    if not clean or not toxic:
        return np.zeros(0, np.uint64), float(toxic > 0)
    a, b = F.col("toxic"), F.col("clean")
    top = (a * (clean - b) - b * (toxic - a)) ** 2 * (clean + toxic)
    chi = top / ((a + b) * (clean + toxic - a - b) * clean * toxic)
    chosen = (
        counted.where(~F.col("total") & (a + b >= LEAST_COUNT) & (a + b < clean + toxic))
        .withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI)
        .orderBy(F.desc("chi"), "code").limit(VOCABULARY).select("code").toPandas()["code"]
    )
    return np.sort(chosen.to_numpy(np.int64).view(np.uint64)), toxic / (clean + toxic)


def _idf(docs: DataFrame, codes: np.ndarray) -> np.ndarray:
    """Smoothed inverse document frequencies over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, rows = shared.value, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                found, owner = terms(piece.column("text"))
                place = np.searchsorted(known, found)
                inside = place < len(known)
                inside[inside] = known[place[inside]] == found[inside]
                pairs = np.unique(owner[inside] * np.int64(len(known) + 1) + place[inside])
                counts += np.bincount(pairs % (len(known) + 1), minlength=len(known))[: len(known)]
                rows += piece.num_rows
        places = np.append(np.flatnonzero(counts), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(np.append(counts[places[:-1]], rows))], ["place", "n"]
        )

    summed = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(codes) + 1)
    counts[summed["place"].to_numpy()] = summed["n"].to_numpy()
    return np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1


def train(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> ToxicityModel:
    """Index about `bound` labelled rows of `train_docs`; idf counts all of `docs`.

    The driver gets VOCABULARY codes and counts and the examples' vectors. An
    empty sample, or one with a single label, gives a model without terms whose
    score is the label's share.
    """
    sample = _labelled(train_docs, labels, bound).dropDuplicates(["text", "toxic"])  # copies vote once
    codes, base = _vocabulary(sample)
    idf = _idf(docs, codes) if len(codes) else np.zeros(0)
    model = ToxicityModel(codes, idf, np.zeros(0), np.zeros(0, np.int64), np.zeros((0, len(codes))), [], base)
    if not len(codes):
        return model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                found = model.vectors(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), piece.column("toxic").cast(pa.int32()),
                     pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                     pa.array([b for _, b in found], pa.list_(pa.float64()))],
                    ["doc_id", "toxic", "place", "weight"],
                )

    rows = sample.mapInArrow(run, "doc_id long, toxic int, place array<int>, weight array<double>").toPandas()
    return with_examples(model, rows["doc_id"], rows["toxic"], rows["place"], rows["weight"])


def with_examples(model: ToxicityModel, ids, labels, places, weights) -> ToxicityModel:
    """Cut the examples that have terms into blocks; the others give the base rate."""
    ids, labels = np.asarray(ids, np.int64), np.asarray(labels, float)
    filled = np.array([len(place) > 0 for place in places], bool)
    if (~filled).any():
        model.base = float((labels[~filled].sum() + 0.02) / ((~filled).sum() + 1))
    # examples with the same first term are near each other, so blocks bound tightly
    lead = np.array([place[np.argmax(weight)] if len(place) else -1 for place, weight in zip(places, weights)], np.int64)
    order = np.lexsort((ids, lead))
    order = order[filled[order]]
    model.ids, model.labels = ids[order], labels[order]
    size = len(model.codes)
    tops, lists = [], []
    for start in range(0, len(order), BLOCK):
        rows = order[start : start + BLOCK]
        own = np.unique(np.concatenate([places[row] for row in rows]))
        matrix = np.zeros((len(rows), len(own)))
        for line, row in enumerate(rows):
            matrix[line, np.searchsorted(own, places[row])] = weights[row]
        top = np.zeros(size, np.float64)
        top[own] = matrix.max(axis=0)
        tops.append(top)
        lists.append((own, matrix))
    model.tops = np.vstack(tops) if tops else np.zeros((0, size))
    model.lists = lists
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, k: int = K) -> DataFrame:
    """`docs` with score, predicted, evidence (ids of the nearest examples) and cosines.

    Texts without a vocabulary term, null and empty ones among them, have no
    evidence and get the share of toxic examples without terms. Existing columns
    of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        known = shared.value
        found = [known.search(*vector, k) for vector in known.vectors(arrays[0])]
        scores = np.array([known.vote(*pair) for pair in found], float)
        return {
            "score": pa.array(scores),
            "predicted": pa.array((scores >= threshold).astype(np.int32)),
            "evidence": pa.array([known.ids[a].tolist() for a, _ in found], pa.list_(pa.int64())),
            "cosines": pa.array([b.tolist() for _, b in found], pa.list_(pa.float64())),
        }

    return add_columns(docs, ["text"], run, "score double, predicted int, evidence array<long>, cosines array<double>")
