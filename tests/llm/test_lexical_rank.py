import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quinhao.llm import lexical_rank as L

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, more string"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return PATTERN.findall(lowered)


def brute(docs, items, k=10):
    counted = [(i, terms(t)) for i, t, *_ in docs]
    counted = [(i, ts, Counter(ts)) for i, ts in counted if ts]
    n_docs, n_terms = len(counted), sum(len(ts) for _, ts, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    queries = defaultdict(list)
    for item, text, *_ in items:
        queries[item] += terms(text)
    out = []
    for item, wanted in queries.items():
        scored = []
        for doc_id, ts, tf in counted:
            m = 100 - 75 + (75 * len(ts) * n_docs) // n_terms
            score = 0
            for t in wanted:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for rank, (score, _, doc_id) in enumerate(scored[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(L, "SEGMENT_WORDS", 400)
    monkeypatch.setattr(L, "STEP", 3)


def corpus(seed=7, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["é", "日本", "ÀB", "9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(n):
        words = rnd.choices(vocabulary, weights, k=rnd.randrange(0, 40))
        docs.append((i, rnd.choice([" ", "_", ", ", "\n"]).join(words)))
    docs += [(i + n, docs[i][1].upper()) for i in range(50)]  # ties, but for letters beyond ASCII
    items = [(j, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 12))), "x") for j in range(25)]
    return docs, items


def test_against_brute_force(spark, make, rows_of, small_segments):
    docs, items = corpus()
    found = L.rank(make(docs, 4), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute(docs, items)


def test_items_with_more_terms_than_a_mask_word(spark, make, rows_of):
    rnd = random.Random(2)
    docs = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(60))) for i in range(200)]
    items = [(1, " ".join(f"w{i}" for i in range(200)), ""), (2, "w1 w1 w1 w2", "")]
    found = L.rank(make(docs), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute(docs, items)


def test_blocks_and_lanes(spark, make, rows_of, small_segments, monkeypatch):
    """Items that can't be broadcast are copied once for each task; results are the same."""
    docs, items = corpus(9)
    want = brute(docs, items)
    monkeypatch.setattr(L, "BLOCK_TERMS", 7)
    monkeypatch.setattr(L, "MOST_BLOCKS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(L.rank(make(docs, 4), spark.createDataFrame(items, ITEMS))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd_rows(spark, odd, odd_rows, clash, rows_of):
    items = [
        (None, "one日", None), (1, None, "a"), (2, "", "a"), (3, "!?", "a"), (4, "one ONE", "a"),
        (4, "one", "b"), (5, "日本語 abc éa b", None), (6, odd_rows[5][1], "long"), (-7, "a b c", ""),
    ]
    for k in (1, 3, 10):
        found = L.rank(clash(odd), spark.createDataFrame(items, ITEMS), k)
        assert rows_of(found) == brute(odd_rows, items, k)


def test_groups_are_left_unscored_when_safe():
    """A few documents hold the rare terms; the many with common ones need no score."""
    docs = [f"common word{i % 50} filler" for i in range(2000)] + ["common rare scarce"] * 12
    found = [L.words(d.encode()) for d in docs]
    vocabulary = {}
    numbered = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in f]) for f in found]
    row = L._segment(0, list(range(len(docs))), numbered, vocabulary).to_pylist()[0]
    segment = L.Segment(row, len(docs), sum(map(len, found)))
    best = L.Best(10)
    scored = L.scan(segment, {b"common": 1, b"rare": 5000, b"scarce": 5000}, best)
    assert scored < 200 and [r[2] for r in best.rows] == list(range(2000, 2010))


def test_tokens_agree_with_the_engine(spark):
    texts = ["", "A-b_c9\u0000x", "日本 Éa ß\u0085y  z", "😀a`{|}~\x7f[\\]^@/:", "ABCxyz019"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    got = {(r.item_id, r.term): r.uses for r in L.item_terms(df).collect()}
    want = Counter((i, t) for i, text in enumerate(texts) for t in terms(text))
    assert got == dict(want)
    for text in texts:
        assert [w.decode() for w in L.words(text.encode())] == terms(text)


def test_every_document_with_terms_is_indexed(odd, odd_rows, small_segments):
    segments = L.build_index(odd).collect()
    assert sum(s.n_docs for s in segments) == sum(bool(terms(r[1])) for r in odd_rows)
    assert sum(s.n_terms for s in segments) == sum(len(terms(r[1])) for r in odd_rows)
    assert len({s.segment for s in segments}) == len(segments)


def test_empty_tables(spark, make, empty):
    items = spark.createDataFrame([(1, "a", "")], ITEMS)
    assert L.rank(empty, items).collect() == []
    assert L.rank(make([(1, "a b")]), items.where("false")).collect() == []
    assert L.rank(make([(1, None), (2, " ")]), items).collect() == []
