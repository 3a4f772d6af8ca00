"""Quality rules: counts against brute force, bounds against sums, and the guarantee."""

import math
import random
import re
from collections import Counter

import pytest

from quinhao.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        sum(x in lines[:k] for k, x in enumerate(lines)), len(inside),
    )


def test_counts_equal_brute_force(odd_rows):
    rnd = random.Random(1)
    texts = [r[1] for r in odd_rows if not r[1] or len(r[1]) < 50_000]
    texts += [
        "".join(rnd.choice("ab \n\t|#é\x0b\x0c\r\x85\xa0") for _ in range(rnd.randrange(200)))
        for _ in range(300)
    ]
    for text in texts:
        assert q.measure(text) == brute(text), text


def test_many_distinct_words(monkeypatch):
    words = [f"w{k}".encode() for k in range(500)] * 2
    assert q.repeated_words(words) == 1000
    assert q.repeated_words(words[:501]) == 0


@pytest.mark.parametrize("n", [1, 5, 40, 300])
def test_bound_equals_the_binomial_sum(n):
    for alpha in (0.005, 0.05, 0.3):
        for delta in (0.05, 1e-4):
            for k in range(0, n + 1, max(1, n // 7)):
                tail = sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))
                assert q.too_many(k, n, alpha, delta) == (k >= n * alpha or tail > delta)


def labelled(spark, make, good=4000, bad=400, seed=2):
    rnd = random.Random(seed)
    rows, labels = [], []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 8)))
    for k in range(good):
        marks = "#" * rnd.choice([0] * 300 + [40])
        rows.append((k, " ".join(word() for _ in range(60)) + marks, "en" if k % 4 else "de"))
        labels.append((k, 1, 0))
    for k in range(good, good + bad):
        rows.append((k, " ".join(word() + " | # " for _ in range(60)), "en"))
        labels.append((k, 0, 0))
    return make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_bad_documents_go_and_few_good_ones(spark, make):
    docs, labels = labelled(spark, make)
    got = {r.doc_id: r.kept for r in q.quality(docs, labels).collect()}
    assert sum(not got[k] for k in range(4000)) <= q.ALPHA * 4000
    assert not any(got[k] for k in range(4000, 4400))
    kept = q.kept_documents(docs, labels)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, v in got.items() if v}


def test_too_few_labels_prove_nothing(spark, make):
    docs, labels = labelled(spark, make, good=100, bad=50)
    cutoffs = q.select_cutoffs(q.features_of(docs), labels).collect()
    assert cutoffs and all(r.cutoff is None for r in cutoffs)
    assert all(r.kept for r in q.quality(docs, labels).collect())


def test_cutoffs_respect_the_bound_in_each_stratum(spark, make):
    docs, labels = labelled(spark, make, good=6000, bad=10, seed=3)
    features = q.features_of(docs)
    strata, tests = 2, 2 * sum(map(len, q.CUTOFFS.values()))
    assert features.select("stratum").distinct().count() == strata
    good = features.join(labels.where("quality = 1"), "doc_id").cache()
    for row in q.select_cutoffs(features, labels).collect():
        mine = good.where(good.stratum == row.stratum)
        n = mine.count()
        for cutoff in q.CUTOFFS[row.rule]:
            k = mine.where(q.rule_values()[row.rule] > cutoff).count()
            if not q.too_many(k, n, q.ALPHA / 4, q.DELTA / tests):
                assert row.cutoff == cutoff
                break
        else:
            assert row.cutoff is None


def test_odd_rows(spark, odd, odd_rows, clash, empty, holds_schema, rows_of):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (6, None, 1), (None, 1, 0), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    docs = clash(odd)
    got = q.quality(docs, labels)
    for r in got.collect():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not r.kept or not base)
    assert got.count() == len(odd_rows)
    kept = q.kept_documents(docs, labels)
    assert holds_schema(docs, kept)
    assert rows_of(kept.select("doc_id")) == rows_of(got.where("kept").select("doc_id"))
    assert q.quality(docs, labels.where("false")).where("kept = base_failed").count() == 0
    assert q.quality(empty, labels).count() == q.kept_documents(empty, labels).count() == 0
