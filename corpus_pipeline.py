"""From raw documents to token files: each stage works on what the one before has kept.

Every stage takes and, but for the last, returns the columns of documents, whatever they are. A
missing id is an id of its own kind; equal rows are separate documents until duplicates go. An empty
table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from declarium.llm import decontaminate, jaccard_join, language_id, mixture, token_blocks
from declarium.llm.common import shared_folder, ship_package, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others go.

    Null and empty texts and texts without a letter have no language, and go. Without labelled
    documents no language is learned, and all go.
    """
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.learn_profiles(docs))


def remove_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Texts without words belong to no group, and stay. Of rows with equal ids and texts one stays;
    rows with equal ids and other texts are told apart. Only groups without any id keep one without.
    """
    ship_package(spark)
    return jaccard_join.first_of_groups(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; mostly contaminated ones go.

    Null and empty texts and clean documents stay as they are; without items all do.
    """
    ship_package(spark)
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them.

    A missing source is a source of its own, the last. Texts without words have nothing to take,
    and go; so do documents that the mix does not take. Others may come several times.
    """
    ship_package(spark)
    return mixture.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row a document, repeated documents included.

    Null and empty texts hold the end id alone. Missing ids come first.
    """
    ship_package(spark)
    return token_blocks.token_blocks(docs, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", remove_duplicates),
    ("decontaminate", remove_benchmark),
    ("mixture", mix_sources),
    ("token_blocks", write_tokens),
]

# Learned profiles, shingle links and token ids are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
