"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.llm import bpe, embeddings, langid, lines, media, minhash, packing, quality, substrings, suffixes
from meshline.llm.common import id_bucket, table
from meshline.llm.oracles import ORACLE_SQL as ORACLE_SQL


def vocabulary() -> str:
    """The public vocabulary file; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 5) != 0)
    scored = quality.classify(docs, labels)
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_bucket("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_minhash": op2_minhash,
    "op3_lines": op3_lines,
    "op4_media_columns": op4_media_columns,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_suffixes": op9_suffixes,
    "op10_substrings": op10_substrings,
}
