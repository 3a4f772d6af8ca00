"""What the operators share."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quinhao.llm import common, kd_shards, packed, parity_join, quality, suffix_dedup
from quinhao.session import shared_folder


def names(spark, before):
    found = set(Path(shared_folder(spark), "quinhao").glob("*")) - before
    return sorted(path.name.rsplit("-", 1)[0] for path in found)


def test_tables_end_with_the_call_that_made_them(spark, make):
    docs = make([(k, f"some words of text number {k % 7} " * 12) for k in range(40)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for call, left in (
        (lambda: parity_join.near_duplicates(docs), ["components", "sets"]),
        (lambda: suffix_dedup.digests(docs, 24), ["marks"]),
        (lambda: kd_shards.kd_shards(docs, shards=3), ["kd-level"]),
        (lambda: quality.quality(docs, labels), ["quality", "quality-cutoffs"]),
        (lambda: quality.kept_documents(docs, labels), ["quality-cutoffs"]),
    ):
        before = set(Path(shared_folder(spark), "quinhao").glob("*"))
        rows = call()
        assert names(spark, before) == left
        rows.collect()  # and these are all that the result reads


def test_scratch_tables_go_on_errors_too(spark):
    before = set(Path(shared_folder(spark), "quinhao").glob("*"))
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.materialize(spark.range(3), "short")
        assert names(spark, before) == ["short"]
        raise ZeroDivisionError
    assert names(spark, before) == []


def test_packed_rows_bring_back_entries_and_owners():
    entry = np.dtype([("key", "<u4"), ("owner", "<u2")])
    owner = np.dtype([("name", "<i8")])
    rnd = np.random.default_rng(1)
    owners = np.array([(k * 11,) for k in range(50)], dtype=owner)
    entries = np.zeros(400, dtype=entry)
    entries["key"], entries["owner"] = rnd.integers(0, 99, 400), rnd.integers(0, 50, 400)
    bucket = rnd.integers(0, 8, 400)
    want = sorted(zip(bucket.tolist(), entries["key"].tolist(),
                      owners["name"][entries["owner"]].tolist()))
    batch = packed.pack(bucket, entries.copy(), owners)
    got = []
    for k in range(batch.num_rows):
        row = pa.Table.from_batches([batch.slice(k, 1)])
        back, names_, _ = packed.unpack(row, entry, owner, entry)
        number = row.column("bucket")[0].as_py()
        got += [(number, int(e), int(n)) for e, n in zip(back["key"], names_["name"])]
    assert sorted(got) == want


def test_utf8_rows_of_slices_and_nulls():
    column = pa.array(["é", None, "", "abc"])
    for part in (column, column.slice(1), column.slice(2, 2)):
        got = [x.tobytes().decode() for x in common.utf8_rows(part)]
        assert got == [x or "" for x in part.to_pylist()]


def test_buckets_hold_a_bounded_number_of_entries():
    for entries in (0, 10**6, 10**9, 10**13):
        bits = packed.bucket_bits(entries, 200)
        assert 2**bits >= 200 and entries / 2**bits <= packed.PER_BUCKET
        assert entries / 8 / 2 ** packed.reply_bits(entries) <= packed.PER_BUCKET
    key = common.mix(np.arange(1000, dtype=np.uint64))
    bucket, short = packed.split_key(key, 6)
    assert bucket.max() < 64 and len(set(zip(bucket.tolist(), short.tolist()))) == 1000
