"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Each stage works on all rows the one before it kept.  All but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellkin.llm import corpus, decontaminate, language, packing, repeats, simhash
from wellkin.plans.stored import store


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one of smallest id."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents stay."""
    return repeats.cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.keep_clean(docs, corpus.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]

#: Language models, byte windows and tokenisation have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
