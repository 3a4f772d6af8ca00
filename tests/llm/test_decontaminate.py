"""Benchmark passages: planted ones are found, clean documents are left alone."""

import random

import numpy as np
import pytest

from quinhao.llm import decontaminate as dc

WORDS = [
    "river", "stone", "house", "summer", "letter", "garden", "window", "market", "bridge", "winter",
    "signal", "forest", "silver", "candle", "mirror", "harbor", "valley", "thunder", "pocket", "needle",
]


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(n))


def edited(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        what = rnd.randrange(3)
        if what == 0:
            out[at] = rnd.choice("xyzq")
        elif what == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice("xyzq"))
    return "".join(out)


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(1)
    return [(k, text_of(rnd, rnd.choice([4, 9, 15, 40]))) for k in range(30)]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    odd = [(100, None), (101, ""), (102, "too short"), (None, "a passage without an id that is long")]
    return spark.createDataFrame([*items, *odd], "item_id bigint, text string")


def distance(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_found_just_where_a_window_is_within_its_edits(items):
    """Against full alignment of every window with every document."""
    rnd = random.Random(2)
    w = dc.prepare(items[:6])
    for trial in range(60):
        item, text = items[rnd.randrange(6)]
        body = edited(rnd, text, rnd.choice([0, 1, 3, 6, 12, 20]))
        doc = dc.normal(text_of(rnd, rnd.randrange(0, 15)) + " " + body + " " + text_of(rnd, 5))
        want = {
            w.items[k]
            for k in range(len(w.items))
            if distance("".join(map(chr, w.points[k])), doc) <= w.edits[k]
        }
        found = {w.items[k] for k, _, _ in next(dc.matches([dc.codes(doc)], w))}
        assert found == want, (trial, item)


def test_a_tenth_of_a_window_may_be_edited():
    """A passage of 120 characters with 10 to 12 of them replaced, far apart."""
    rnd = random.Random(4)
    text = dc.normal(text_of(rnd, 40))[:120].strip().ljust(120, "k")
    w = dc.prepare([(1, text)])
    for edits in (10, 11, 12):
        body = list(text)
        for k in range(edits):
            body[k * 9] = "#"
        doc = dc.codes(text_of(rnd, 9) + " " + "".join(body) + " " + text_of(rnd, 9))
        assert [w.items[k] for k, _, _ in next(dc.matches([doc], w))] == [1], edits


def found_in(w, doc):
    return {w.items[k] for k, _, _ in next(dc.matches([dc.codes(dc.normal(doc))], w))}


def test_a_part_is_found_wherever_it_is_cut():
    """80 characters of an item, with 6 edits too, and 13 words of any length."""
    rnd = random.Random(6)
    text = dc.normal(text_of(rnd, 40))[:233].strip().ljust(233, "k")
    w = dc.prepare([(1, text)])
    for start in range(len(text) - dc.SHORT - dc.STEP + 1):
        part = text[start : start + dc.SHORT + dc.STEP]
        for body in (part, edited(rnd, part, 6)):
            assert found_in(w, f"{text_of(rnd, 8)} {body} {text_of(rnd, 8)}") == {1}, start
    words = [rnd.choice(["a", "to", "it", "we", "of"]) for _ in range(60)]
    w = dc.prepare([(2, " ".join(words))])
    for start in range(60 - dc.RUN + 1):
        part = " ".join(words[start : start + dc.RUN])
        assert found_in(w, f"{text_of(rnd, 8)} {part} {text_of(rnd, 8)}") == {2}, start
        cut = " ".join(words[start : start + 5])
        assert found_in(w, f"{text_of(rnd, 8)} {cut} {text_of(rnd, 8)}") == set(), start


def test_short_items_are_found_as_whole_words(make, spark):
    items = [(1, "Blue  Whale"), (2, "42"), (3, "富士山"), (4, ""), (5, "(x)"), (6, "blue whale")]
    w = dc.prepare(items)
    assert found_in(w, "A blue\nwhale.") == {1, 6}
    assert found_in(w, "blue whale") == {1, 6}
    assert found_in(w, "true blue whales, 142 or 420, f(x), 4 2, 富士") == set()
    assert found_in(w, "it is 42!") == found_in(w, "42") == {2}
    assert found_in(w, "私は富士山に登る (x)") == {3, 5}
    assert found_in(w, "w " * dc.PIECE + "42 " + "w " * 9) == {2}
    docs = make([(1, "so 42"), (2, "so 421"), (3, None), (4, "")])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r)[:2] for r in dc.contamination(docs, benchmark).collect()} == {(1, 2)}
    assert {r.doc_id for r in dc.clean_documents(docs, benchmark).collect()} == {2, 3, 4}


def test_planted_passages(make, clash, benchmark, items, rows_of, holds_schema):
    rnd = random.Random(3)
    rows = [(k, text_of(rnd, rnd.randrange(0, 120))) for k in range(60)]
    planted = {}
    for k, (item, text) in enumerate(items):
        shown = [text, text.upper(), text.replace(" ", " \n "), edited(rnd, text, 2)][k % 4]
        rows.append((100 + k, text_of(rnd, 30) + "\n" + shown + " " + text_of(rnd, 30)))
        planted[100 + k] = item
    long = text_of(rnd, 20_000)
    rows += [(300, long), (301, long + " " + items[5][1]), (302, None), (303, "")]
    planted[301] = items[5][0]
    docs = clash(make(rows))
    got = dc.contamination(docs, benchmark).select("doc_id", "item_id")
    assert {tuple(r) for r in got.collect()} == set(planted.items())
    clean = dc.clean_documents(docs, benchmark)
    assert holds_schema(docs, clean)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {
        r[0] for r in rows
    } - set(planted)


def test_blocks_give_the_same(make, benchmark, items, monkeypatch):
    rows = [(k, "some words before " + text) for k, (_, text) in enumerate(items)]
    docs = make(rows)
    whole = {tuple(r) for r in dc.contamination(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "BLOCK_CHARS", 500)
    monkeypatch.setattr(dc.benchmark_blocks, "__defaults__", (500,))
    assert {tuple(r) for r in dc.contamination(docs, benchmark).collect()} == whole
    assert len(whole) == len(items)


def test_grams_tell_texts_apart():
    points = dc.codes("abcdefghijklmnop")
    assert len(dc.grams(points)) == 9 and len(set(dc.grams(points).tolist())) == 9
    assert (dc.grams(points)[3:] == dc.grams(points[3:])).all()
    assert len(dc.grams(points[:7])) == 0


def test_band_alignment_equals_full_alignment():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40)))
        pattern = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))
        want = distance(pattern, text)
        lows, width = np.array([-len(pattern)]), len(pattern) + len(text) + 1
        got = dc.align(dc.codes(pattern)[None], [dc.codes(text)], lows, width, 25)
        assert got == [want]


def test_documents_aligned_together_are_aligned_each_for_itself(monkeypatch):
    rnd = random.Random(8)
    items = [(k, text_of(rnd, rnd.randrange(8, 60))) for k in range(12)]
    w = dc.prepare(items)
    docs = []
    for k in range(60):
        body = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(0, 9)):
            body[rnd.randrange(len(body))] = "#"
        docs.append(dc.codes(dc.normal(text_of(rnd, 9) + " " + "".join(body) + " " + text_of(rnd, 9))))
    together = list(dc.matches(docs, w))
    assert together == [next(dc.matches([d], w)) for d in docs]
    assert 5 < sum(map(bool, together))
    monkeypatch.setattr(dc, "ALIGNED", 3)
    assert list(dc.matches(docs, w)) == together


def test_odd_rows_and_empty_tables(odd, empty, benchmark, spark):
    assert dc.contamination(odd, benchmark).count() == 0
    assert dc.clean_documents(odd, benchmark).count() == odd.count()
    none = benchmark.where("false")
    assert dc.contamination(odd, none).count() == 0
    assert dc.contamination(empty, benchmark).count() == 0
    assert np.all(dc.prepare([]).sieve == 0)
