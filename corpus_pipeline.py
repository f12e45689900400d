"""A training corpus from `documents`: five stages, each on what the one before it kept.

Language identification, exact deduplication, near-deduplication by shared shingles, mixing of sources
to target weights, best-fit packing. Each stage's result is written as Parquet to the shared
folder and read again, so a lost executor costs at most the running stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill.llm import exact_dedup, language_id, minhash, mixing, packing
from casemill.llm.common import documents, release, settle, stash, sweep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the stage's own documents and drops those of no known language."""
    profiles = language_id.learn(language_id.training_rows(docs), "doc_id", "text", "lang")
    return language_id.keep_identified(docs, profiles)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the smallest doc_id."""
    settle(spark, docs)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more: the one with the smallest doc_id."""
    settle(spark, docs)
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, with the words that it takes."""
    settle(spark, docs)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    settle(spark, docs)
    return packing.packed_rows(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs)
            sweep(spark, but=docs)
            release(spark)
    return docs


#: No stage but the second can be written in SQL: profiles, fingerprints, permutations and bins are not.
ORACLE_SQL = None
