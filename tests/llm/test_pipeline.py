"""The pipeline's stages on whole small tables."""

import hashlib

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from quinhao.llm import parity_join, quality
from quinhao.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry_module.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry_module.oracle_sql()) <= names
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination",
        "byte-level BPE",
    ]


def test_stages_keep_columns_and_take_effect(spark, holds_schema):
    docs = documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF).cache()
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        if k < 4:
            assert holds_schema(docs, after), name
        if k == 0:
            assert ids(after) == ids(quality.quality(docs, labels).where("kept"))
        if k == 1:
            assert ids(after) == ids(
                parity_join.near_duplicates(docs).where("doc_id = component_id")
            )
        if k == 2:
            assert ids(after) == ids(docs)
        if k == 3:
            found = {r.doc_id for r in entry_rows(spark, docs)}
            assert ids(after) == ids(docs) - found
        if k == 4:
            texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
            got = after.collect()
            assert {r.doc_id: bytes(r.decoded) for r in got} == texts
            assert all(len(r.ids) == 4 * r.n_tokens for r in got)
        docs = after


def entry_rows(spark, docs):
    from quinhao.llm import decontaminate

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    return decontaminate.contamination(docs, items).collect()


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op7_byte_bpe"])
def test_queries_cover_whole_tables(spark, name):
    docs = {r.doc_id: (r.text or "").encode() for r in documents(spark, SF).collect()}
    got = entry_module.queries()[name](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs)
    if name == "op7_byte_bpe":
        for r in got:
            assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id]).hexdigest()


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() <= documents(spark, SF).count()
