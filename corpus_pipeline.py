"""The corpus pipeline: five stages over `documents`, each written and read again as the next one's input.

All stages but the last keep the columns of documents; the last returns the token ids' digests.
Rows are judged each by their own text, also where they repeat a doc_id or have none; null and empty
texts fail the quality rules, very long ones are read whole, an empty table stays one, and columns
of any other name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import blocks, bpe, decontaminate, pii, quality_rules, queries, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failed lines."""
    return quality_rules.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode(docs, queries.word_bpe_path())


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Fingerprints, the field and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, with a table in the shared folder after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = blocks.table(docs)
    return docs
