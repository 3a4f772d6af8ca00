"""Repeated passages against brute force over spans."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quinhao.llm import sentence_spans as ss


def brute(rows, min_words):
    """Texts left when documents are read in the order of their ids."""
    seen, out, first = {}, {}, {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for value, _, _ in ss.spans(ss.split_sentences(text), min_words):
            first.setdefault(value, doc_id)
    for k, (doc_id, text) in enumerate(rows):
        if not text:
            out[k] = text
            continue
        sentences = ss.split_sentences(text)
        keep = [True] * len(sentences)
        seen = set()
        for value, start, end in ss.spans(sentences, min_words):
            if value in seen or (doc_id is not None and first[value] < doc_id):
                for j in range(start, end):
                    keep[j] = False
            seen.add(value)
        out[k] = "".join(s for s, j in zip(sentences, keep) if j)
    return sorted(((r[0], out[k]) for k, r in enumerate(rows)), key=repr)


def sentence(rnd, n=None):
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(n or rnd.randrange(2, 16))]
    return " ".join(words).capitalize() + rnd.choice([".", "!", "?", "...", "\n"])


def passage(rnd, n):
    return " ".join(sentence(rnd) for _ in range(n))


def made_rows(seed):
    rnd = random.Random(seed)
    shared = [passage(rnd, rnd.randrange(3, 9)) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.3 else passage(rnd, 3) for _ in range(4)]
        rows.append((500 - 3 * k, "\n".join(parts)))
    return rows


def test_pieces_are_the_text():
    rnd = random.Random(1)
    for text in ["", "one", "a. b.  c!\n\nd", "...", " . \n", "3.14 is", passage(rnd, 9), "w " * 500]:
        assert "".join(ss.split_sentences(text)) == text
    assert max(len(s.split()) for s in ss.split_sentences(" ".join(f"w{k}" for k in range(900)))) < 100


def test_spans_have_two_sentences_and_enough_words():
    rnd = random.Random(2)
    sentences = ss.split_sentences(passage(rnd, 30))
    for _, start, end in ss.spans(sentences, 20):
        assert end - start >= 2
        assert sum(len(s.split()) for s in sentences[start:end]) >= 20
    assert ss.spans(["Too short.", "To say."], 20) == []


def test_texts_equal_brute_force(make, clash, rows_of, holds_schema):
    rows = made_rows(3)
    rows += [(900 + k, rows[4][1]) for k in range(3)] + [(5, rows[4][1].upper()), (6, None), (7, "")]
    docs = clash(make(rows))
    cleaned = ss.without_repeats(docs)
    assert holds_schema(docs, cleaned)
    assert rows_of(cleaned.select("doc_id", "text")) == brute(rows, ss.MIN_WORDS)
    assert cleaned.where("n_chars <> length(text)").count() == 0
    assert cleaned.where("source <> 's'").count() == 0


def test_long_passages_stay_once_wherever_they_stand(make):
    """Passages of over 50 words, with and without full stops, inside other sentences."""
    rnd = random.Random(4)
    plain = " ".join("".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(70))
    stopped = passage(rnd, 8)
    rows = []
    for k in range(30):
        rows.append((k, f"{sentence(rnd)} Some {k} words then {plain} and on {k}. {sentence(rnd)}"))
        rows.append((100 + k, f"{passage(rnd, 3)} {stopped} {passage(rnd, 2)}"))
        rows.append((200 + k, passage(rnd, 6)))
    got = {r.doc_id: r for r in ss.without_repeats(make(rows), counts=True).collect()}
    for k in range(1, 30):
        assert plain not in got[k].text and len(got[k].text) < len(rows[0][1]) * 0.6
        assert stopped not in got[100 + k].text
        assert got[200 + k].n_removed == 0
    assert plain in got[0].text and stopped in got[100].text


def test_passages_inside_short_sentences_at_both_ends(make):
    """51 words in sentences of 15, 21 and 15, led in and followed by words of each document."""
    rnd = random.Random(7)
    for trial in range(4):
        words = ["".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(51)]
        middle = " ".join(words[15:36])
        body = f"{' '.join(words[:15])}. {middle}. {' '.join(words[36:])}"
        own = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(5))
        rows = [(k, f"{sentence(rnd)} {own()} {body} {own()}. {sentence(rnd)}") for k in range(12)]
        got = {r.doc_id: r.text for r in ss.without_repeats(make(rows)).collect()}
        assert got[0] == rows[0][1]
        assert all(middle not in got[k] for k in range(1, 12)), trial


def test_passages_without_blanks(make):
    rnd = random.Random(8)
    letters = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    parts = "。".join(letters(30) for _ in range(5))
    for body in (parts, letters(150)):
        rows = [(k, f"{letters(25)}{body}{letters(25)}。{letters(40)}") for k in range(12)]
        assert all("".join(ss.split_sentences(t)) == t for _, t in rows)
        got = {r.doc_id: r.text for r in ss.without_repeats(make(rows)).collect()}
        assert got[0] == rows[0][1]
        assert all(body[50:100] not in got[k] and len(got[k]) >= 90 for k in range(1, 12))


def test_odd_rows_and_empty(odd, odd_rows, empty, rows_of):
    assert rows_of(ss.without_repeats(odd).select("doc_id", "text")) == brute(
        [r[:2] for r in odd_rows], ss.MIN_WORDS
    )
    assert ss.without_repeats(empty).count() == 0


def test_batches_are_read_in_bounded_parts():
    texts = ["x" * 30, None, "y" * 500, "\u00e9" * 20, "", "z" * 90, "w" * 5]
    batch = pa.record_batch({"doc_id": list(range(7)), "text": texts})
    parts = list(ss.slices(batch, 1, most=100))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 2, 2]
    assert list(ss.slices(batch.slice(0, 0), 1, most=100)) == []


def test_rows_of_a_batch_read_in_parts_are_whole(make, monkeypatch, rows_of):
    rows = made_rows(12) + [(900, None), (901, "")]
    monkeypatch.setattr(ss, "SLICE", 300)
    cleaned = ss.without_repeats(make(rows, partitions=1), counts=True)
    assert rows_of(cleaned.select("doc_id", "text")) == brute(rows, ss.MIN_WORDS)
    assert cleaned.where(F.col("n_chars") != F.length("text")).count() == 0
