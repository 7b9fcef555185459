"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.frames import add_columns, bounded_sample, pieces

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_DOCUMENTS = 20_000
SMOOTHING = 0.5
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class LanguageModel:
    """Log probabilities, one row per bucket and one column per language."""

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whether texts hold letters, and per order the buckets and texts of their n-grams.

    Runs of other characters count as one space; n-grams never span two texts.
    """
    lowered = [(text or "").lower() for text in texts]
    lengths = np.fromiter((len(text) + 1 for text in lowered), np.int64, len(lowered))
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), lengths)
    letter = _letters()[codes]
    last = np.append(letter[1:] | (owner[1:] != owner[:-1]), True)
    kept = letter | last
    codes, owner, letter = np.where(letter, codes, 32)[kept].astype(np.uint32), owner[kept], letter[kept]
    found = []
    for order in ORDERS:
        count = max(0, len(codes) - order + 1)
        mix, whole = np.full(count, order, np.uint32), np.ones(count, bool)
        with np.errstate(over="ignore"):
            for place in range(order):
                mix = mix * _FACTORS[0] + codes[place : place + count] * _FACTORS[1 + place]
            mix = (mix ^ (mix >> np.uint32(15))) * _FACTORS[1]
            mix ^= mix >> np.uint32(13)
        whole = owner[:count] == owner[order - 1 : order - 1 + count]
        if order == 1:
            whole = letter
        found.append((mix[whole] & np.uint32(BUCKETS - 1), owner[:count][whole]))
    return np.bincount(owner[letter], minlength=len(lowered)) > 0, found


def train(docs: DataFrame, key: str = "doc_id", bound: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """Count n-grams per language over about `bound` rows with text and language.

    Rows with null text or language are left out. Without any row the model
    knows no language. The driver gets languages x BUCKETS counts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(labelled, F.col(key), bound).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for piece in pieces(batch, ["text"]):
                languages = np.array(piece.column("lang").to_pylist(), object)
                _, found = grams(piece.column("text").to_pylist())
                for language in set(languages):
                    own = languages == language
                    rows[language] = rows.get(language, 0) + int(own.sum())
                    total = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                    for buckets, owner in found:
                        total += np.bincount(buckets[own[owner]], minlength=BUCKETS)
        for language, total in totals.items():
            full = np.flatnonzero(total)
            places = np.append(full, -1)  # bucket -1 counts documents
            values = np.append(total[full], rows[language])
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(places)), pa.array(places, pa.int32()), pa.array(values, pa.int64())],
                ["lang", "bucket", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    table = np.zeros((BUCKETS + 1, len(languages)))
    columns = {name: place for place, name in enumerate(languages)}
    np.add.at(table, (summed["bucket"].to_numpy(), summed["lang"].map(columns).to_numpy(int)), summed["n"].to_numpy())
    documents, table = table[-1], table[:-1] + SMOOTHING
    return LanguageModel(
        languages,
        np.log(table / table.sum(axis=0)).astype(np.float32),
        np.log(documents / documents.sum()) if languages else np.zeros(0),
    )


def posterior(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text holds a letter, and its probability per language."""
    lettered, found = grams(texts)
    scores = np.tile(model.log_prior, (len(texts), 1)).astype(float)
    for buckets, owner in found:
        if not len(buckets):
            continue
        firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        scores[owner[firsts]] += np.add.reduceat(model.log_probability[buckets], firsts, axis=0, dtype=float)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf))
    return lettered, scores / scores.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its probability, in columns of these names.

    Null texts and texts without a letter get `und` and score 0, as does all
    text when the model knows no language. Ties go to the first language by
    name. Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        known, texts = shared.value, arrays[0].to_pylist()
        if not known.languages:
            return dict(zip(names, (pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64()))))
        lettered, chances = posterior(known, texts)
        best = chances.argmax(axis=1)
        found = [known.languages[place] if ok else UNKNOWN for place, ok in zip(best, lettered)]
        return {
            names[0]: pa.array(found, pa.string()),
            names[1]: pa.array(np.where(lettered, chances.max(axis=1), 0.0)),
        }

    return add_columns(docs, ["text"], predict, f"`{names[0]}` string, `{names[1]}` double")
