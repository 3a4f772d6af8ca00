"""Token counts and byte-level encoding against the public libraries."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from quinhao.llm import bpe, prefix_counts
from quinhao.llm.queries import pattern, vocabulary

PIECES = vocabulary("piece_bpe_32k.model")
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding(
        "own", pat_str=pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    made = ["".join(rnd.choice("ab cthe ▁\né日.,1") for _ in range(rnd.randrange(80))) for _ in range(150)]
    return [
        "", " ", "  a  b\n\tç☃ x①ﬁ ", "▁▁▁", "a" * 500, " " * 70 + "x", "é" * 50 + "日本語 😀",
        "<s> </s><unk> <0x0A> <|endoftext|>", "\x00a​", *made,
    ]


def test_every_prefix_is_counted_as_the_library_does(pieces, texts):
    counter = prefix_counts.PrefixCounter(PIECES)
    for text in texts:
        want = [len(pieces.encode(text[:n])) for n in range(len(text) + 1)]
        assert counter.table(text).tolist() == want, text
        assert counter.count(text) == want[-1]
        for budget in (0, 1, 5, 40):
            fits = max(n for n, count in enumerate(want) if count <= budget)
            assert prefix_counts.fitting(counter.table(text), budget) == fits, (text, budget)


def test_memo_starts_anew_when_full(pieces):
    counter = prefix_counts.PrefixCounter(PIECES, memo_words=3)
    text = "several words that pass the memo's bound again and again several words"
    assert counter.count(text) == len(pieces.encode(text))
    assert len(counter._memo) <= 3


def test_steps_of_any_size_are_packed():
    for steps in ([], [1, 0, -3, 127, -128], [300, -5], [70_000, -70_000, 1]):
        blob = prefix_counts.pack_steps(np.array(steps, dtype=np.int32))
        assert prefix_counts.counts_of(blob).tolist() == [0, *np.cumsum(steps).tolist()]
    assert prefix_counts.counts_of(None).tolist() == [0]


def test_budgets_and_places_from_a_stored_table(make, odd_rows, clash, pieces, rows_of, tmp_path):
    """Answered from the written column alone, as the library answers for each prefix's text."""
    rows = [r for r in odd_rows if len(r[1] or "") < 2000]
    rows += [(50, "naïve 日本語 words, \n\n and  blanks " * 9)]
    path = str(tmp_path / "prefixes")
    prefix_counts.prefix_table(clash(make(rows)), PIECES).write.parquet(path)
    table = make([]).sparkSession.read.parquet(path)
    counts = {r[1]: [len(pieces.encode((r[1] or "")[:k])) for k in range(len(r[1] or "") + 1)]
              for r in rows}
    limit = F.when(F.col("doc_id") == 50, F.lit(None)).otherwise(F.col("n_chars") % 7 - 1)
    want = []
    for r in rows:
        c = counts[r[1]]
        most = None if r[0] == 50 else (len(c) - 1) % 7 - 1
        over = most is not None and c[-1] > most
        fit = max(k for k, n in enumerate(c) if n <= max(most, 0)) if over else len(c) - 1
        want.append((r[0], len((r[1] or "").encode()), c[-1], over, fit, c[fit]))
    assert rows_of(prefix_counts.within(table, limit)) == sorted(want, key=repr)
    places = F.when(F.col("doc_id") != 1, F.array(F.lit(-1), F.lit(3), F.lit(None), F.lit(10**6)))
    want = []
    for r in rows:
        c, at = counts[r[1]], [-1, 3, None, 10**6]
        if r[0] is None or r[0] == 1:
            want.append((r[0], None, None))
        else:
            want.append((r[0], at, [0, c[min(3, len(c) - 1)], None, c[-1]]))
    assert rows_of(prefix_counts.tokens_at(table, places)) == sorted(want, key=repr)


def test_counts_of_documents(odd, odd_rows, clash, pieces, rows_of):
    got = rows_of(
        prefix_counts.token_counts(clash(odd), PIECES, limit=100).drop("fit_chars")
    )
    want = []
    for row in odd_rows:
        text = row[1] or ""
        n = len(pieces.encode(text))
        want.append((row[0], len(text.encode()), n, n > 100))
    assert got == sorted(want, key=repr)


def test_merges_equal_the_library(encoding, texts):
    codec = bpe.Codec(RANKS, pattern(), memo=50)
    for text in texts:
        ids = np.frombuffer(codec.encode(text), dtype="<u4").tolist()
        assert ids == encoding.encode_ordinary(text), text
        assert codec.decode(codec.encode(text)) == text.encode()


def test_long_pre_token_equals_the_library(encoding):
    rnd = random.Random(3)
    word = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert bpe.merge(word.encode(), bpe.read_ranks(RANKS)) == encoding.encode_ordinary(word)


def test_merge_order_with_ranks_below_their_parts():
    ranks = {bytes([c]): c - 97 for c in b"abcd"}
    ranks |= {b"ab": 10, b"bc": 9, b"abc": 5, b"bcd": 8, b"abcd": 7}

    def slow(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            pairs = [
                (ranks[parts[k] + parts[k + 1]], k)
                for k in range(len(parts) - 1)
                if parts[k] + parts[k + 1] in ranks
            ]
            if not pairs:
                return [ranks[p] for p in parts]
            _, k = min(pairs)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rnd = random.Random(4)
    for _ in range(500):
        piece = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 14)))
        assert bpe.merge(piece, ranks) == slow(piece)


def test_rank_queue_pops_lowest_rank_then_leftmost():
    rnd = random.Random(6)
    queue, held = bpe.RankQueue(), []
    for _ in range(3000):
        if held and rnd.random() < 0.45:
            want = min(held)
            held.remove(want)
            assert queue.pop() == want
        else:
            item = (rnd.randrange(50_000) if rnd.random() < 0.5 else rnd.randrange(3), len(held))
            held.append(item)
            queue.push(*item)
    while held:
        want = min(held)
        held.remove(want)
        assert queue.pop() == want
    assert queue.pop() == (-1, -1)


def test_round_trip_of_documents(odd, odd_rows, clash, encoding, rows_of):
    got = rows_of(bpe.round_trip(clash(odd), RANKS, pattern()))
    want = []
    for row in odd_rows:
        text = row[1] or ""
        ids = np.asarray(encoding.encode_ordinary(text), dtype="<u4")
        want.append(
            (
                row[0],
                len(ids),
                hashlib.sha256(ids.tobytes()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    assert got == sorted(want, key=repr)


def test_empty_tables(empty):
    assert prefix_counts.token_counts(empty, PIECES).count() == 0
    assert bpe.encode_decode(empty, RANKS, pattern()).count() == 0
    assert bpe.round_trip(empty, RANKS, pattern()).count() == 0
