"""Laws of the shards."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quinhao.llm import kd_shards as kd


def made_rows(n=1500, hot=0.35):
    rnd = random.Random(1)
    rows = []
    for k in range(n):
        if rnd.random() < hot:
            text = "the same text in a third of all rows " * 3
        else:
            text = "é" * int(rnd.paretovariate(1.2) * 10) + str(rnd.randrange(n))
        rows.append((k, text, rnd.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_every_row_once_in_shards_of_near_equal_bytes(make, clash, shards):
    rows = made_rows()
    got = kd.shards_by_bytes(clash(make(rows)), shards).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in got:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert (r.law, r.grown_shard) == ("bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    fair = sum(sizes) / shards
    slack = max(r.size for r in got) + kd.GROUP_SHARE * fair * 6
    assert max(sizes) <= fair + slack and min(sizes) >= fair - slack


def test_equal_texts_stay_together_but_for_very_large_groups(make):
    rows = made_rows(hot=0) + [(5000 + k, f"copy {k % 40}") for k in range(160)]
    got = kd.kd_shards(make(rows), shards=24)
    parted = got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1")
    assert parted.count() == 0


def test_target_bytes(make):
    docs = make(made_rows(600))
    total = kd.kd_shards(docs, shards=1).agg(F.sum("size")).first()[0]
    got = kd.kd_shards(docs, target_bytes=total // 10 + 1, dimensions={"id": F.col("doc_id")})
    assert got.select("shard").distinct().count() == 10
    # one dimension: the shards are ranges of it, but for copies of one text
    with pytest.raises(ValueError):
        kd.kd_shards(docs)


def test_odd_rows_empty_tables_and_blocks(odd, odd_rows, clash, empty):
    got = kd.with_slots(kd.kd_shards(clash(odd), shards=5), block_rows=2).collect()
    assert len(got) == len(odd_rows)
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(8, 0)}
    assert kd.shards_by_bytes(empty).count() == 0


def test_no_python_in_the_plan(make):
    plan = kd.shards_by_bytes(make(made_rows(50)), 3)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_position_orders_strings(spark):
    words = ["", "a", "aa", "ab", "b", "é", "zz", "src1", "src10", "src2"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select("w", kd.position(F.col("w")).alias("p")).orderBy("p").collect()
    assert [r.w for r in got] == sorted(words, key=lambda w: w.encode())
