"""From raw documents to token ids: quality, near copies, repeated passages, leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs, so a lost executor repeats part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quinhao.llm import bpe, decontaminate, parity_join, quality, sentence_spans
from quinhao.llm.common import documents, materialize, ship, table
from quinhao.llm.queries import pattern, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the calibrated cutoffs reject go."""
    ship(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    ship(spark)
    return parity_join.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out."""
    ship(spark)
    return sentence_spans.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with part of a benchmark item go."""
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of what is left; ids are little-endian 32-bit."""
    ship(spark)
    return bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

# Stages score, compare and encode text in ways that SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
