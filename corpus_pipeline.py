"""A training corpus from ``documents``: five stages, each one operator over all rows its predecessor kept.

Each stage but the last returns the columns of documents; ``run`` writes each
stage's rows as Parquet in the shared folder and rereads them for the next.

Edge cases: a null text has no letter and goes in the first stage; a null
doc_id is its own document, is never learned from and takes part in nothing
that compares documents, but is kept and packed; rows that repeat a doc_id
stay or go together and are packed as often as they stand; an empty table
gives no sequences; further columns may have any names and are kept up to the
last stage; ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshline.llm import langid, lines, minhash, packing, substrings
from meshline.llm.common import Stage, id_bucket, spare, table
from meshline.llm.queries import vocabulary

#: A text whose n-grams are less likely than this, against those its language was learned from, is of no learned language.
LEAST_FIT = -2.7


def _texts(docs: DataFrame) -> DataFrame:
    """Documents that still have words, with n_chars as their texts are now."""
    docs = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0d]"))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or of no language that was learned."""
    columns = docs.columns
    model = langid.fit(docs.where(id_bucket("doc_id", 4) != 2))
    lang, score, fit = (spare(c, columns) for c in ("lang_pred", "score", "fit"))
    return langid.predict(docs, model, (lang, score, fit)).where((F.col(lang) != langid.UNKNOWN) & (F.col(fit) >= LEAST_FIT)).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of lines; a document with nothing left goes."""
    return _texts(lines.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id."""
    return minhash.clean(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of passages of 20 words and more; a document with nothing left goes."""
    return _texts(substrings.clean(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pack", pack)]

#: Language ID and tokenising have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage.write(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
