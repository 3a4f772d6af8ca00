"""Registered queries of the training-text operators, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quinhao.llm import (
    bpe,
    chunk_recipes,
    decontaminate,
    fill_in_middle,
    kd_shards,
    language_id,
    lexical_rank,
    oracle,
    parity_join,
    prefix_counts,
    quality,
    sentence_spans,
    suffix_dedup,
    url_filter,
)
from quinhao.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file: ``QUINHAO_TOKENIZERS`` names another folder."""
    import public_tokenizers

    folder = os.environ.get("QUINHAO_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir), length=400)


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    )


def kd_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shards_by_bytes(documents(spark, sf_dir), shards=24)


def sentence_spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.without_repeats(documents(spark, sf_dir), counts=True).select(
        "doc_id", "text", "n_sentences", "n_removed"
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(
        documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096
    )


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern()
    )


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def parity_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(documents(spark, sf_dir))


def chunk_recipes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.copies(documents(spark, sf_dir))


def lexical_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def fill_in_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": suffix_dedup_query,
        "op2_url_filter": url_filter_query,
        "op3_decontamination": contamination,
        "op4_kd_shards": kd_shards_query,
        "op5_sentence_spans": sentence_spans_query,
        "op6_token_counts": token_counts,
        "op7_byte_bpe": byte_bpe,
        "op8_language_id": language_id_query,
        "op9_quality_rules": quality_query,
        "op10_parity_join": parity_join_query,
        "op11_chunk_recipes": chunk_recipes_query,
        "op12_lexical_rank": lexical_rank_query,
        "op13_fill_in_middle": fill_in_middle_query,
    }


def oracle_sql() -> dict[str, str]:
    """Of the others, models, alignments and merges, tests/llm holds against brute force."""
    return oracle.oracle_sql()
