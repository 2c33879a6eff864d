"""From documents to training tokens: four stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import bpe_automaton, decontaminate, language_id, simhash_dedup
from docweave.llm.common import remove_folder, shared_dir
from docweave.llm.queries import WORD_BPE, bound_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, letterless or of no likely language go."""
    bound_batches(spark)
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    bound_batches(spark)
    return simhash_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    bound_batches(spark)
    return bpe_automaton.encode_digests(docs, WORD_BPE)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

#: Neither the network nor the fingerprints are expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``.

    What lies between them goes to the shared folder, each stage's output until the next one is written; the last
    one's stays for the reader. Nulls in any column, empty tables, repeated rows and further columns are what the stages say they are.
    """
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
        if i:
            remove_folder(spark, f"{top}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
