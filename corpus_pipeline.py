"""A corpus pipeline of five stages over ``documents``; part of the llm subpackage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return the
columns of ``documents``, whatever further columns those have.  ORACLE_SQL is None:
a trained model, fingerprints and hypergeometric draws have no SQL form, so the
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm import exact_dedup, language_id, mixing, packing, simhash
from shutterlake.llm.common import documents, written
from shutterlake.llm.queries import language_fold, tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, learned from the labelled part of ``docs``; rejected documents go."""
    model = language_id.fit(docs, language_fold())
    judged = language_id.verdicts(docs, model)
    return judged.filter("NOT rejected").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 against a fresh index: of equal texts the largest doc_id stays."""
    return exact_dedup.survivors(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component the smallest doc_id stays."""
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a row for each time the mix takes a document, in shard order."""
    return mixing.Mix(docs).rows()


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a row for each piece of a training sequence."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
