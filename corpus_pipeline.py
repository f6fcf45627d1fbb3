"""Corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.llm.bpe import encode_texts
from kosha.llm.bpe_queries import vocabulary
from kosha.llm.decontaminate import decontaminate
from kosha.llm.jaccard import keep_one_of_each
from kosha.llm.quality_model import filter_documents
from kosha.llm.secret_scan import redact
from kosha.llm.shared import keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels of documents still here."""
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that with the least doc_id."""
    return keep_one_of_each(docs, width=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows the text."""
    cleaned = redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else cleaned


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens and the token ids of every document."""
    coded = encode_texts(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("contamination", contamination), ("secrets", secrets), ("token_ids", token_ids)]

ORACLE_SQL = None  # a trained model and a tokenizer: tested stage by stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result kept as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
