"""Language identification: held-out accuracy, and what is never used."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quinhao.llm import language_id as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(docs):
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_predictions_use_the_text_only(docs):
    want = {r.doc_id: r.lang_pred for r in li.identify(docs).collect()}
    # languages of held-out rows, sources and lengths are not looked at
    other = docs.withColumns(
        {
            "lang": F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang")),
            "source": F.lit("none"),
            "n_chars": F.lit(0),
        }
    )
    assert {r.doc_id: r.lang_pred for r in li.identify(other).collect()} == want


def test_kernel_is_the_normalised_share_of_common_bits():
    texts = [b"one text and another", b"eine sprache und noch eine", b"one text and more", b""]
    bits = np.zeros((4, li.BITS), dtype=np.uint8)
    for k, t in enumerate(texts):
        li.presence(np.frombuffer(t, np.uint8), bits[k])
    x = bits.astype(float)
    kernel = (x @ x.T) / np.sqrt(np.maximum(np.outer(x.sum(1), x.sum(1)), 1))
    assert np.allclose(np.diag(kernel)[:3], 1) and kernel[0, 2] > kernel[0, 1]
    # the folded weights give what kernel ridge regression on landmarks gives
    model = li.fit(np.packbits(bits[:3], axis=1), ["a", "b", "a"])
    target = np.array([[1, 0], [0, 1], [1, 0]]) - np.array([2 / 3, 1 / 3])
    gram = kernel[:3, :3]
    inverse = np.linalg.inv(gram)
    lift = gram @ inverse @ gram
    solved = np.linalg.solve(lift + li.RIDGE * 3 * np.eye(3), target)
    assert np.allclose(model.score(bits[:3]), lift @ solved + [2 / 3, 1 / 3], atol=1e-4)


def test_case_and_sections(monkeypatch):
    data = np.frombuffer("Some Text, é, of a Few words. ".encode() * 20, np.uint8)
    whole, lower, parts = (np.zeros(li.BITS, np.uint8) for _ in range(3))
    li.presence(data, whole)
    li.presence(np.frombuffer(data.tobytes().lower(), np.uint8), lower)
    monkeypatch.setattr(li, "SECTION", 37)
    sizes = [len(p) for p in li.sections(data)]
    assert len(sizes) == -(-len(data) // 37) and max(sizes) <= 37 + 3 and max(sizes) - min(sizes) <= 4
    for part in li.sections(data):
        li.presence(part, parts)
    assert (whole == lower).all() and (whole == parts).all()
    assert [len(p) for p in li.sections(data[:0])] == [0]


def test_score_of_a_long_text_is_the_mean_of_its_sections(monkeypatch):
    rnd = np.random.default_rng(3)
    model = li.Model(["a", "b"], rnd.normal(size=(li.BITS, 2)).astype(np.float32), np.zeros(2))
    texts = [rnd.integers(32, 127, n).astype(np.uint8) for n in (0, 10, 64, 65, 1000)]
    monkeypatch.setattr(li, "SECTION", 64)
    want = []
    for data in texts:
        parts = list(li.sections(data))
        bits = np.zeros((len(parts), li.BITS), np.uint8)
        for k, part in enumerate(parts):
            li.presence(part, bits[k])
        want.append(model.score(bits).mean(axis=0))
    monkeypatch.setattr(li, "BLOCK", 3)
    assert np.allclose(model.mean_scores(texts), want, atol=1e-5)


def test_megabytes_of_each_language(docs, make):
    texts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").collect()
    names = sorted({r.lang for r in texts})
    long = []
    for n in names:
        own = [r.text for r in texts if r.lang == n]
        size = sum(map(len, own))
        # words parted anew make n-grams that no document has
        words = " ".join(own * (1 + 2_000_000 // size)).split()
        order = np.random.default_rng(5).permutation(len(words))
        long.append(" ".join(words[k] for k in order))
    assert min(map(len, long)) > 1_900_000
    model = li.train(docs.where(~li.held_out()))
    rows = make([(k, text, None) for k, text in enumerate(long)])
    got = {r.doc_id: r.lang_pred for r in li.predict(rows, model).collect()}
    assert [got[k] for k in range(len(names))] == names


def test_very_many_languages():
    rnd = np.random.default_rng(1)
    own = rnd.integers(0, 256, (3000, li.BITS // 8)).astype(np.uint8)
    own &= rnd.integers(0, 256, own.shape).astype(np.uint8)
    names = [f"l{k:04}" for k in range(3000)]
    model = li.fit(np.repeat(own, 2, axis=0), [n for n in names for _ in range(2)])
    assert model.weights.shape == (li.BITS, 3000) and model.languages == names
    marks = np.unique(np.linspace(0, 5999, li.LANDMARKS).astype(int)) // 2
    best = model.score(np.unpackbits(own[marks], axis=1)).argmax(axis=1)
    assert (best == marks).mean() > 0.9  # of those that are landmarks


def test_odd_rows(make, odd_rows, clash, empty):
    rows = [*odd_rows, (20, "123 456 !?", "en"), (21, "½ ²", "en"), (22, "ü", "de")]
    got = li.identify(clash(make(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3, 14, 20, 21):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
        else:
            assert not r.held_out
    assert li.identify(empty).count() == 0
    unknown = li.identify(make([(1, "some text", None), (2, "more text", None)])).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_repeated_ids_don_t_pass_the_sample(make):
    rows = [(1, f"text number {k} in one language", "en") for k in range(300)]
    rows += [(k, "ein anderer text", "de") for k in range(2, 40)]
    model = li.train(make(rows), sample=16)
    assert model.languages == ["de", "en"]
