"""Thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, chat_format, decontamination, language_id, near_duplicates, quality_classifier, quality_rules, secret_scan, sharding, token_counts
from granary.session import read_spread, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(spark, docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(~quality_classifier.held_out(F.col("doc_id")))
    model = quality_classifier.train(spark, learn, read_table(spark, sf_dir, "labels"))
    found = quality_classifier.classify(spark, docs, model)
    return found.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(spark, read_spread(spark, sf_dir, "documents")).drop("text_md5")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(spark, read_spread(spark, sf_dir, "documents"), vocabulary)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(spark, read_spread(spark, sf_dir, "documents"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(spark, read_spread(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(spark, read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.apply_rules(spark, docs, quality_rules.references(spark, docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, read_spread(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


_TURNS = """
SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_quality_classifier,
            op3_ngram_jaccard_join,
            op4_bpe,
            op5_secret_scan,
            op6_string_tiling,
            op7_hypergeometric_shards,
            op8_quality_rules,
            op9_token_counts,
            op10_chat_format,
            pipeline,
        )
    }


_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_ESCAPED = r"regexp_replace({}, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|sep>)', '\1\\\2\3', 'g')".format

OP10_SQL = f"""
WITH t AS ({_TURNS}),
w AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS opens, lead(role) OVER o IS DISTINCT FROM role AS closes FROM t WINDOW o AS (PARTITION BY conv_id {_ORDER})),
n AS (SELECT *, length({_ESCAPED("text")})
  + CASE WHEN NOT opens THEN 5 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 1 ELSE 8 + length({_ESCAPED("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) END
  + CASE WHEN NOT closes THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 5 ELSE 9 END AS chars FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::bigint AS formatted_chars
FROM n GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": OP10_SQL}
