"""A training corpus in five stages, each an operator of shardloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Each works on what the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import jaccard, langid, mixing, queries, secrets
from shardloom.llm.common import arrow_limits, plain_reads, shared_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the mixture inference finds a language."""
    arrow_limits(spark)
    plain_reads(spark)
    return langid.keep_identified(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates (five words, 80 %)."""
    arrow_limits(spark)
    plain_reads(spark)
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    plain_reads(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    plain_reads(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each document of the mix."""
    plain_reads(spark)
    return queries.bpe_digest(spark, docs, mb=1)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language inference, PartEnum verification of hashes and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage-{name}")
    return docs
