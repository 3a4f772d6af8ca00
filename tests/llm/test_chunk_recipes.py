import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quinhao.llm import chunk_recipes as R
from quinhao.llm.common import materialize


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    out = []
    for row in rows:
        ids = groups[row[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256((row[1] or "").encode()).hexdigest()
        out.append((row[0], keep, len(ids), row[0] == keep, digest))
    return sorted(out, key=repr)


def varied(seed=3):
    """Copies, texts that differ in one character at any place, and texts cut from each other."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé日") for _ in range(rnd.randrange(1, 50))) for _ in range(300)]
    long = " ".join(rnd.choice(words) for _ in range(4000))
    texts = [long, long[:-1], long + " ", " " + long, long.replace("a", "b", 1), long[5000:]]
    texts += ["x" * n for n in (31, 32, 33, 5000)] + ["\n" * 9, "\n" * 8, "a b", "a\u0000b"]
    rows = [(i, rnd.choice(texts)) for i in range(120)]
    return rows + [(500, long), (500, long), (500, long[:-1]), (None, long)]


@pytest.mark.parametrize("hash_bits", [64, 3, 1])
def test_copies_against_brute_force(make, rows_of, hash_bits):
    """Few bits of hash make nearly all chunks collide: their numbers tell them apart."""
    rows = varied()
    assert rows_of(R.copies(make(rows), hash_bits=hash_bits)) == brute(rows)


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_odd_rows(odd, odd_rows, clash, rows_of, hash_bits):
    assert rows_of(R.copies(clash(odd), hash_bits=hash_bits)) == brute(odd_rows)


def test_chunks_cover_the_text(make):
    rows = varied()
    chunked = R.cut_chunks(make(rows), "doc_id", "text").collect()
    assert len(chunked) == len(rows)
    for r in chunked:
        assert "".join(r.chunks) == r.text
        assert len(r.chunks) == len(r.hashes)
        assert all(r.chunks)
    assert max(len(r.chunks) for r in chunked) > 10


def test_text_without_a_hit_is_cut_into_steps(make):
    for n in (1, R.MOST - 1, R.MOST, R.MOST + 1, 3 * R.MOST, 3 * R.MOST + 1):
        (row,) = R.cut_chunks(make([(1, "aa " * n)]), "doc_id").collect()
        assert "".join(row.chunks) == "aa " * n
        assert max(map(len, row.chunks)) <= 3 * R.MOST


def test_chunks_meet_again_after_an_edit(make):
    """Cuts depend on content: an insertion changes the chunks around it only."""
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20_000))
    edited = text[:1000] + " inserted words " + text[1000:]
    one, two = (
        set(r.hashes) for r in R.cut_chunks(make([(1, text), (2, edited)]), "doc_id").collect()
    )
    assert len(one) > 100 and len(one ^ two) <= 6


def test_store_and_recipes_restore_every_text(make, rows_of):
    rows = [r for r in varied() if r[0] is not None]
    docs = make(rows).withColumn("row", F.monotonically_increasing_id())
    chunked = materialize(R.cut_chunks(docs, "row", "text"), "chunks")
    store = R.chunk_store(chunked)
    total = chunked.select(F.sum(F.size("chunks"))).first()[0]
    assert store.select(F.sum("uses")).first()[0] == total and store.count() < total
    back = R.restored(chunked, store)
    assert rows_of(back) == rows_of(chunked.select("row", "text"))


def test_rows_that_stay(make, clash, holds_schema):
    rows = varied()
    docs = clash(make(rows))
    kept = R.without_copies(docs)
    assert holds_schema(docs, kept)
    top = {}
    for doc_id, text in rows:
        top[text] = max(top.get(text, -1), -1 if doc_id is None else doc_id)
    want = {(doc_id, text) for text, doc_id in top.items()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want


def test_hot_group_is_spread(spark, make):
    """Half of all rows are copies of one text; no task joins more than its share of them."""
    rows = [(i, "one text" if i % 2 else f"text {i}") for i in range(4000)]
    docs = make(rows, 8)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        result = R.copies(docs)
        assert result.where("group_size > 1").count() == 2000
        assert result.where("kept").count() == 2001
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_no_python_in_the_plan(make):
    chunked = R.cut_chunks(make([(1, "a b c")]), "doc_id")
    plan = R.chunk_store(chunked)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(empty):
    assert R.copies(empty).collect() == []
    assert R.without_copies(empty).collect() == []
