"""From raw documents to token ids: language, near duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langid, mixing, ngram_join, secrets, sentencepiece_bpe
from spindrift.llm._stage import count_written, drop, drop_written, plain, shared_folder, text_batches
from spindrift.llm.registry import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def any_columns(stage: Stage) -> Stage:
    """A stage that keeps columns of any name besides COLUMNS, also names that its operator uses itself."""

    @functools.wraps(stage)
    def with_them(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(spark, plain(docs, COLUMNS), sf_dir).toDF(*docs.columns)

    return with_them


@any_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language: those labelled ``und`` (no text, no letter) go. Missing values of
    lang are filled in."""
    text_batches(spark)
    labelled = langid.identify(docs, langid.train(docs), keep=docs.columns)
    known = labelled.where("lang_pred <> 'und'")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@any_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of similar ones."""
    text_batches(spark)
    return ngram_join.one_of_each(docs).select(*docs.columns)


@any_columns
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    text_batches(spark)
    scanned = secrets.scan(docs, keep=docs.columns)
    text = F.coalesce("masked", "text")
    chars = F.when(F.col("masked").isNull(), F.col("n_chars")).otherwise(F.length("masked").cast("long"))
    return scanned.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


@any_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, and of the text they decode to."""
    text_batches(spark)
    return sentencepiece_bpe.encode_digests(plain(docs, COLUMNS), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't state the language labels, the forest or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of all stages over the documents of sf_dir. What a stage has written on the way goes once its result
    is written, and that result once the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        since = count_written()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        drop_written(spark, since)
        drop(spark, before)
        before = [f"{folder}/{name}"]
        docs = spark.read.parquet(*before)
    return docs
