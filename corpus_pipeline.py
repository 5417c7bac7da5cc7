"""A corpus pipeline: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's `docs`. All
but the last return the columns of documents.

- language_id: the model learns from the languages that the documents state; texts without a letter, or in which no language has two fifths
  of the text, go.
- near_duplicates: of each class of documents with equal or similar texts, the one of least doc_id stays.
- decontamination: documents that hold a benchmark item go.
- secret_scan: secrets are replaced by their kind in brackets; every document stays, and n_chars follows its text.
- bpe: every text becomes token ids, with their digest and that of the decoded bytes.

Nulls, empty texts, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontamination, language_id, near_duplicates, secret_scan
from granary.session import Scratch, fresh, read_table

#: Least proportion of the predicted language.
LEAST_SHARE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(spark, docs)
    (found,) = fresh(docs, "_language")
    marked = docs.withColumn(found, language_id.predictor(spark, model)(F.col("text")))
    kept = F.col(f"{found}.score") >= LEAST_SHARE if model.languages else F.lit(True)
    return marked.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_secrets(spark, docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(spark, docs, vocabulary, with_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact),
    ("bpe", encode),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    written = None
    for name, stage in STAGES:
        before, written = written, scratch.write(stage(spark, docs if written is None else written, sf_dir), name)
        if before is not None:
            scratch.drop(before)
    return written
