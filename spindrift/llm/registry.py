"""Queries of the numbered operators over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import centroids, chat_format, fingerprints, hard_negatives, html_extract, langid, lm_score, media, mixing, ngram_join, secrets, sentencepiece_bpe, toxicity
from ._stage import text_batches

#: Where the public tokenizers lie; None: where the package public_tokenizers has them.
TOKENIZERS: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; one in fewer files and row groups than there are cores is dealt over these."""
    text_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    extracted = html_extract.extract_pages(pages, html_extract.train(pages))
    return extracted.withColumn("n_chars", F.length("text").cast("long"))


def id_remainder(by: int) -> Column:
    """crc32 of the doc_id as text, mod by; null ids count as remainder null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), id_remainder(3) == 1)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder(7) == 2, F.lit(False))
    return lm_score.score_documents(table(spark, sf_dir, "documents"), held_out)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_remainder(5) != 0)
    scored = toxicity.score_documents(docs, model)
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect_media(media.store_texts(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("masked")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.edit_probe(docs, fingerprints.lexicon(docs))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_html_extract": op3_html_extract,
        "op4_mixing": op4_mixing,
        "op5_language_id": op5_language_id,
        "op6_lm_score": op6_lm_score,
        "op7_toxicity": op7_toxicity,
        "op8_media": op8_media,
        "op9_secrets": op9_secrets,
        "op10_fingerprints": op10_fingerprints,
        "op11_centroids": op11_centroids,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op11_centroids": centroids.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_chat_format": chat_format.ORACLE}
