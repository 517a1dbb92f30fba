"""The registered queries of this package: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from declarium.llm import (
    conversation_trie,
    decontaminate,
    html_text,
    jaccard_join,
    language_id,
    license_scan,
    mixture,
    simhash,
    spelling_variants,
    token_blocks,
    token_counts,
    toxicity,
    vector_search,
)
from declarium.llm.common import ship_package, table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return language_id.language_id(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return license_scan.scan_documents(table(spark, folder, "documents"))


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return vector_search.exact_top_k(table(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return token_blocks.token_blocks(table(spark, folder, "documents"), with_ids=False)


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.benchmark_hits(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return html_text.extract_pages(table(spark, folder, "pages"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op10_mixture(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return mixture.mixture(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spelling_variants.spelling_variants(table(spark, folder, "documents"), garbled=True)


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return conversation_trie.prefix_trie(
        table(spark, folder, "conversations"), conversation_trie.rebuilt_path
    )


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_duplicates(table(spark, folder, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_language_id, op2_license_scan, op3_exact_top_k, op4_toxicity, op5_token_blocks,
        op6_decontaminate, op7_html_text, op8_jaccard_join, op9_token_counts, op10_mixture, op11_spelling_variants, op12_conversation_trie, op13_simhash,
    )
}
