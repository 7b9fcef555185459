"""Quality scores learnt from trusted positives and unlabelled web text.

A small network over style features minimises the non-negative unbiased risk:
with class prior p, positives P and unlabelled rows U the risk is
p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]) for the logistic loss l. The
prior is the smallest share of unlabelled to positive rows above any score of
a held-back part, as in regions without negatives that share is the prior.
The weights of the last half of all steps are averaged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import add_columns, bounded_sample, pieces
from tastegrid.llm.text import words

POSITIVES = 20_000
UNLABELLED = 20_000
HIDDEN = 24
STEPS = 2_400
BATCH = 512

_KINDS = np.zeros(256, np.int64)  # 0: other
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[0x20, *range(9, 14)]] = 4
_KINDS[[ord(char) for char in ".,;:'\"()-?"]] = 5
_KINDS[[ord(char) for char in "!"]] = 6
_KINDS[[ord(char) for char in "|"]] = 7
_KINDS[[ord(char) for char in "#$%&*"]] = 8
_KINDS[[ord(char) for char in "<>{}[]=/\\_~^`@+"]] = 9
_KINDS[128:] = 10
_N_KINDS = 11
N_FEATURES = 21


def features(texts: pa.Array) -> np.ndarray:
    """Style features of each text; null and empty texts get zeros."""
    cut = words(texts)
    count = len(texts)
    table = np.zeros((count, N_FEATURES))
    kind = _KINDS[cut.data]
    owner = np.repeat(np.arange(count), np.diff(cut.offsets))
    shares = np.bincount(owner * _N_KINDS + kind, minlength=count * _N_KINDS).reshape(count, _N_KINDS)
    size = np.maximum(np.diff(cut.offsets), 1)
    n_words = np.diff(cut.of)
    word_of = np.repeat(np.arange(count), n_words)
    per_word = np.maximum(n_words, 1)
    length = cut.end - cut.begin
    upper = np.append(0, np.cumsum(kind == 2))
    loud = (upper[cut.end] - upper[cut.begin]) > 0.5 * length
    symbols = np.append(0, np.cumsum((kind >= 6) & (kind <= 9)))
    marked = symbols[cut.end] > symbols[cut.begin]
    repeated = np.zeros(len(length), bool)
    repeated[1:] = (cut.code[1:] == cut.code[:-1]) & (word_of[1:] == word_of[:-1])
    order = np.lexsort((cut.code, word_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (cut.code[order][1:] != cut.code[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
    lines = np.bincount(owner[cut.data == 10], minlength=count)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(word_of, flags, minlength=count) / per_word

    table[:, 0] = np.log1p(n_words)
    table[:, 1:12] = shares / size[:, None]
    table[:, 12] = share(length) / 10
    table[:, 13] = share(loud)
    table[:, 14] = share(marked)
    table[:, 15] = share(repeated)
    table[:, 16] = np.bincount(word_of[order], fresh, minlength=count) / per_word
    table[:, 17] = shares[:, 6] / per_word
    table[:, 18] = shares[:, 7] / per_word
    table[:, 19] = lines / per_word
    table[:, 20] = np.log1p(np.bincount(word_of, length**2, minlength=count) / per_word) / 10
    return table * (np.diff(cut.offsets) > 0)[:, None]


@dataclass
class QualityModel:
    """Scaling of the features, two layers and the class prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = np.clip((rows - self.mean) / self.scale, -8, 8)
        first, bias, second, offset = self.weights
        return 1 / (1 + np.exp(-np.clip(np.tanh(rows @ first + bias) @ second + offset, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> list[np.ndarray]:
    """Adam steps over batches of positives and unlabelled rows, features scaled."""
    draw = np.random.default_rng(seed)
    width = positive.shape[1]
    weights = [
        draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ]
    first = [np.zeros_like(weight) for weight in weights]
    second = [np.zeros_like(weight) for weight in weights]
    mean = [np.zeros_like(weight) for weight in weights]
    step, total = 0, STEPS
    for _ in range(total):
        own = positive[draw.integers(0, len(positive), BATCH)]
        other = unlabelled[draw.integers(0, len(unlabelled), BATCH)]
        rows = np.vstack([own, other])
        hidden = np.tanh(rows @ weights[0] + weights[1])
        margin = hidden @ weights[2] + weights[3]
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        p, u = slice(0, BATCH), slice(BATCH, None)
        # loss of f as positive: log(1 + e^-f), slope chance - 1; as negative: log(1 + e^f), slope chance
        negative = np.logaddexp(0, margin)
        rest = negative[u].mean() - prior * negative[p].mean()
        slope = np.zeros(len(rows))
        slope[p] += prior * (chance[p] - 1) / BATCH
        if rest > 0:  # else the maximum is flat
            slope[u] += chance[u] / BATCH
            slope[p] -= prior * chance[p] / BATCH
        back = np.outer(slope, weights[2]) * (1 - hidden**2)
        grads = [rows.T @ back, back.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
        step += 1
        rate = 0.01 * (1 - 0.9 * step / total)
        for k, grad in enumerate(grads):
            grad = grad + 1e-4 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if 2 * step > total:
            mean = [a + w for a, w in zip(mean, weights)]
    return [a / (total - total // 2) for a in mean]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive rows above a score, where positives are many."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.7, 14))
    own = np.array([(positive >= cut).mean() for cut in cuts])
    other = np.array([(unlabelled >= cut).mean() for cut in cuts])
    noise = np.sqrt(other * (1 - other) / max(len(unlabelled), 1)) / np.maximum(own, 1e-9)
    return float(np.clip((other / np.maximum(own, 1e-9) + noise).min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> QualityModel | None:
    """A model, or None without positives or unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    everything = np.vstack([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-6
    positive = np.clip((positive - mean) / scale, -8, 8)
    unlabelled = np.clip((unlabelled - mean) / scale, -8, 8)
    order = np.random.default_rng(seed).permutation(len(positive))
    other = np.random.default_rng(seed + 1).permutation(len(unlabelled))
    p, u = order[: len(order) // 2 + 1], other[: len(other) // 2 + 1]
    probe = QualityModel(np.zeros(positive.shape[1]), np.ones(positive.shape[1]), _fit(positive[p], unlabelled[u], 0.5, seed), 0.5)
    rest_p, rest_u = positive[order[len(p):]], unlabelled[other[len(u):]]
    prior = estimate_prior(probe.score(rest_p), probe.score(rest_u)) if len(rest_p) and len(rest_u) else 0.5
    return QualityModel(mean, scale, _fit(positive, unlabelled, prior, seed + 2), prior)


def _collect(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                rows = features(piece.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], ["row"])

    rows = docs.select("text").mapInArrow(run, "row array<double>").toPandas()["row"]
    return np.vstack(list(rows)) if len(rows) else np.zeros((0, N_FEATURES))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel | None:
    """Learn from about `positives` rows labelled 1 and `unlabelled` rows of any kind.

    A document counts as trusted when all its labels that aren't null are 1.
    The driver gets one short feature row per sampled document.
    """
    trusted = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    chosen = bounded_sample(trusted.select("doc_id"), F.col("doc_id"), positives)
    own = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # bounded by `positives`
    other = bounded_sample(docs, F.col("doc_id"), unlabelled, seed=29)
    return fit(_collect(own), _collect(other))


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """`docs` with score and predicted.

    Null and empty texts are scored as texts without words. Without a model
    every score is 0.5. Existing columns score and predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        rows = features(arrays[0])
        scores = shared.value.score(rows) if shared.value is not None else np.full(len(rows), 0.5)
        return {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return add_columns(docs, ["text"], run, "score double, predicted int")
