import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quinhao.llm import fill_in_middle as fim

ANY_TEXT = st.text(alphabet=st.sampled_from("ab <>PSM\né日😀́"), max_size=60)


def expected(doc_id, text):
    """The contract, on code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


@settings(max_examples=300, deadline=None)
@given(ANY_TEXT)
def test_index_converts_every_cut(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    index = fim.SparseIndex(data)
    assert index.n_points == len(text)
    assert len(index.at_byte) == sum(ord(c) > 127 for c in text)  # nothing for ASCII
    for point in range(len(text) + 1):
        byte = len(text[:point].encode())
        assert index.to_byte(point) == byte and index.to_point(byte) == point


@settings(max_examples=300, deadline=None)
@given(ANY_TEXT, st.integers(0, 10_000))
def test_transform_and_rebuild(text, doc_id):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n, form, prefix, middle, output = fim.transform(data, doc_id, "1", 10, 20)
    assert (doc_id, n, form, prefix, middle, output.decode()) == expected(doc_id, text)
    assert fim.rebuild(output, form) == (prefix, middle, text.encode())


@pytest.mark.parametrize("text", ["x<S", "<", "<P", "a<M", "<S<M", "P>", "M>S>", "<<<"])
def test_parts_that_look_like_markers(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    for doc_id in range(200):
        _, form, *_, output = fim.transform(data, doc_id, "1", 10, 20)
        assert fim.rebuild(output, form)[2] == text.encode()


def test_odd_rows(odd, odd_rows, clash, rows_of):
    want = sorted((expected(r[0], r[1]) for r in odd_rows), key=repr)
    cut = fim.fill_in_middle(clash(odd))
    assert rows_of(cut) == want
    found = fim.restored(cut)
    assert found.columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        "found_prefix_chars", "found_middle_chars", "text",
    ]
    texts = sorted(((r[0], r[1] or "") for r in odd_rows), key=repr)
    assert rows_of(found.select("doc_id", "text")) == texts
    for r in found.collect():
        assert (r.prefix_chars, r.middle_chars) == (r.found_prefix_chars, r.found_middle_chars)


def test_small_batches_and_settings(make, rows_of, monkeypatch):
    rows = [(i, f"é{i} " * 50) for i in range(40)]
    docs = make(rows, 2)
    whole = rows_of(fim.digests(docs))
    monkeypatch.setattr(fim, "BATCH_BYTES", 100)
    assert rows_of(fim.digests(docs)) == whole
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, 0, 100).collect()} == {"spm"}
    other = fim.fill_in_middle(docs, seed="2").select("output")
    assert rows_of(other) != rows_of(fim.fill_in_middle(docs).select("output"))


def test_megabytes_of_each_script(make):
    long = {1: "a " * 700_000, 2: "日本" * 400_000, 3: "aé😀" * 300_000}
    docs = make(list(long.items()), 1)
    for r in fim.fill_in_middle(docs).collect():
        assert tuple(r) == expected(r.doc_id, long[r.doc_id])


def test_empty_table(empty):
    assert fim.digests(empty).collect() == []
    assert fim.restored(fim.fill_in_middle(empty)).collect() == []
