"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import decontaminate, jaccard, langid, mixing, tokens
from tastegrid.llm.frames import columns_of, materialize, temporary
from tastegrid.session import materialize as keep

#: A document stays when its language is at least this likely.
LEAST_LIKELY = 0.5
#: Documents are near duplicates when their shingles of so many words are alike to so many percent.
SHINGLE_WORDS, LEAST_ALIKE = 5, 80
MIX = mixing.Mix(mixing.DEFAULT_WEIGHTS, percent=60, max_epochs=1)


#: Rows that Spark hands to Python at a time; of whole documents its default number is tens of MB.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """A stage that bounds the batches of its session, which is asked when its result is written."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return function(spark, docs, sf_dir)

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts of no likely language; fill null languages.

    The model learns from the documents whose language is known.
    """
    found = langid.identify(docs, langid.train(docs), ("__lang", "__likely"))
    kept = found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__likely") >= LEAST_LIKELY))
    filled = F.coalesce("lang", "__lang").alias("lang")
    return kept.select(*(filled if name == "lang" else column for name, column in zip(docs.columns, columns_of(docs))))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of linked documents, and what links with nothing.

    Texts without words and rows with null ids stay; rows that repeat id and
    text stay once, and rows that share an id and differ in text each count.
    """
    return jaccard.keep_one(docs, length=SHINGLE_WORDS, percent=LEAST_ALIKE)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark.

    Null and empty texts hold none, null and empty items are in none, and rows
    that repeat an id or have none are rows of their own.
    """
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents from the tree of sources until the budget of tokens is spent.

    Null sources and languages are leaves of their own; ties and repeated rows
    are put in one order by hashes, id and text. Of no rows, none are taken.
    """
    return mixing.mix_documents(docs, MIX, prefix="__mix_").select(*columns_of(docs))


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids and offsets and read them back, a row per document.

    Null and empty texts are their end id alone; null ids come first, and rows
    that repeat an id follow one another by text.
    """
    read = tokens.read(spark, tokens.write(docs))
    return read.select("doc_id", "start", "n_tokens", tokens.crc32_of("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_ids", token_ids),
]

#: Language and token ids can't be told in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for _, step in STAGES[:-1]:
            docs = materialize(step(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))
