"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import (
    alignment,
    bytebpe,
    decontaminate,
    html,
    jaccard,
    langid,
    mixing,
    neighbors,
    quality,
    repeats,
    spelling,
    tokens,
    toxicity,
)
from tastegrid.llm.frames import fold
from tastegrid.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_queries() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    dataset = tokens.write(table(spark, folder, "documents"))
    return tokens.read(spark, dataset).select(
        "doc_id", "start", "n_tokens", tokens.crc32_of("ids").alias("ids_crc32")
    )


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_ORACLES["op3_decontamination"] = decontaminate.LEAKS_SQL

MIX = mixing.Mix(mixing.DEFAULT_WEIGHTS, percent=60, max_epochs=2)


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.mix_documents(table(spark, folder, "documents"), MIX)
    return chosen.select("doc_id", *mixing.LEVELS, "epoch", "n_tokens")


_ORACLES["op7_mixing"] = mixing.mix_sql(MIX)


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = fold(F.col("doc_id"), 5, 0)
    model = quality.train(docs.where(~held_out), labels.where(~held_out))
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_groups(table(spark, folder, "documents"))


@query
def op2_nearest_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(neighbors.usable(table(spark, folder, "embeddings")))
    index = neighbors.fit(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return neighbors.nearest(rows, rows.where("vec_id % 50 = 0"), index)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = fold(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, docs.where(~held_out), labels.where(~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


@query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = html.extract(pages.select("page_id", "url", "html"), html.train(pages))
    return found.select("page_id", "url", "text", "n_chars")


@query
def op1_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.find_repeats(table(spark, folder, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bytebpe.digests(bytebpe.encode(docs).drop("text"))
