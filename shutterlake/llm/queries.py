"""The named queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, line_dedup, mixing, packing, quality_rules, simhash, token_counts, token_output, warc
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("word_bpe_49k.json"), limit=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(documents(spark, sf_dir), exact_dedup.DigestIndex(spark))


def language_fold() -> Column:
    """Rows that a language model may learn from."""
    return language_id.crc_fold() != 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, language_fold())
    held_out = docs.select("doc_id", "text", (language_id.crc_fold() == 1).alias("held_out"))
    return language_id.identify(held_out, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of all documents to the shared folder; a row for each sequence."""
    return token_output.write_shards(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.verdicts(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of response records made of all pages."""
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.membership(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).drop("distance")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": op1_token_counts,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_mixing": op4_mixing,
        "op5_token_output": op5_token_output,
        "op6_line_dedup": op6_line_dedup,
        "op7_warc": op7_warc,
        "op8_simhash": op8_simhash,
        "op9_quality_rules": op9_quality_rules,
        "op10_packing": op10_packing,
    }


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
