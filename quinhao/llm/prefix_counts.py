"""Token counts at every prefix of a text, by dynamic programming over a piece vocabulary.

The last piece of the encoding of a prefix is the one piece that ends there and may follow the
last piece of the prefix before it, so

    count(prefix) = count(prefix without its last piece) + 1

and the counts of all prefixes come from one pass. Two adjacent pieces are compatible when the
merges of their joined text give just these two; an encoding is right when all neighbours are.
Texts fall apart before each run of word marks, which no merge crosses, so the counts of a word
are worked out once and remembered, and a document's counts are running sums of its words'.

``prefix_table`` keeps the counts of all prefixes of a document in one binary value, as differences
of a byte each. Budgets, truncation and places are answered from it (``within``, ``tokens_at``),
without the text and without the vocabulary.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import by_batch

MARK = "▁"  # stands for a blank in pieces
MEMO_WORDS = 1_000_000  # words remembered by a worker; beyond that it starts anew
MEMO_CHARS = 48  # longer words are not remembered


class PrefixCounter:
    """Counts of a merge vocabulary whose pieces are merged in the order of their scores.

    A character outside the vocabulary costs one token per UTF-8 byte. ``null`` and empty texts
    have no token.
    """

    def __init__(self, model_file: str, memo_words: int = MEMO_WORDS) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.score = {p: model.get_score(i) for p, i in zip(self.pieces, ids)}
        # finds the pieces that end at each place of a word
        self.ends = ahocorasick.Automaton()
        for k, piece in enumerate(self.pieces):
            self.ends.add_word(piece, (len(piece), k))
        self.ends.make_automaton()
        self.chars = frozenset(p for p in self.pieces if len(p) == 1)
        if any(not self.chars.issuperset(p) for p in self.pieces):
            raise ValueError("a piece holds a character that is no piece")
        crossing = re.compile(f"[^{MARK}]{MARK}")
        parted = not any(map(crossing.search, self.score))
        # a line's end is never part of a piece here; the last alternative is trailing marks
        line = "" if "\n" in self.chars else "\n"
        words = f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else "")
        self.words = re.compile(words if parted else "(?s).+").findall
        self._follows: dict[int, bool] = {}
        self._memo = _Steps(self.inner, memo_words)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, before: int, piece: int) -> bool:
        """Whether piece number ``piece`` may stand after ``before``, or first if that is -1."""
        parts = [self.pieces[k] for k in (before, piece) if k >= 0]
        if len(self._follows) > 1_000_000:
            self._follows.clear()
        known = self._merged("".join(parts)) == parts
        self._follows[before << 20 | piece] = known
        return known

    def inner(self, word: str) -> list[int]:
        """Counts of the prefixes of one word, from the empty one to the whole."""
        if self.chars.issuperset(word):
            return self._inner(word)
        counts = [0]
        for known, run in groupby(word, self.chars.__contains__):
            # no piece holds an unknown character, so nothing merges across it
            part = "".join(run)
            more = self._inner(part) if known else accumulate(map(_width, part), initial=0)
            more = list(more)
            base = counts[-1]
            counts += [base + n for n in more[1:]]
        return counts

    def _inner(self, word: str) -> list[int]:
        follows = self._follows
        counts: list = [0] + [None] * len(word)
        last = [-1] * (len(word) + 1)
        for at, (size, piece) in self.ends.iter(word):
            end = at + 1
            if counts[end] is not None:
                continue
            start = end - size
            key = last[start] << 20 | piece
            known = follows.get(key)
            if known is None:
                known = self._may_follow(last[start], piece)
            if known:
                counts[end] = counts[start] + 1
                last[end] = piece
        return counts

    def _split(self, text: str) -> list[str]:
        return self.words(MARK + text.replace(" ", MARK)) if text else []

    def steps(self, text: str | None) -> np.ndarray:
        """How much each character of ``text`` adds to the count."""
        words = self._split(text or "")
        out = np.frombuffer(b"".join(map(self._memo.__getitem__, words)), dtype=np.int32)
        if not len(out):
            return out
        # the mark put before the text is not a character of it
        return np.concatenate([[out[0] + out[1]], out[2:]], dtype=np.int32)

    def count(self, text: str | None) -> int:
        return int(self.steps(text).sum())

    def table(self, text: str | None) -> np.ndarray:
        """Counts of all prefixes of ``text`` by their number of characters, 0 first."""
        return counts_of(pack_steps(self.steps(text)))


def pack_steps(steps: np.ndarray) -> bytes:
    """Steps in as few bytes each as they need, one nearly always; the first byte is that number."""
    width = next(w for w in (1, 2, 4) if (steps == steps.astype(f"<i{w}")).all())
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def counts_of(prefixes: bytes | None) -> np.ndarray:
    """Counts of all prefixes, the empty one first, from what ``pack_steps`` made."""
    steps = np.frombuffer(prefixes, f"<i{prefixes[0]}", offset=1) if prefixes else np.zeros(0)
    out = np.zeros(len(steps) + 1, dtype=np.int64)
    np.cumsum(steps, out=out[1:])
    return out


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens; counts may fall again."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def answer(prefixes: bytes | None, limit: int | None) -> tuple[int, bool, int, int]:
    """Tokens, whether these are over ``limit``, and characters and tokens of what is within."""
    counts = counts_of(prefixes)
    n = int(counts[-1])
    over = limit is not None and n > limit
    fit = fitting(counts, max(limit, 0)) if over else len(counts) - 1
    return n, over, fit, int(counts[fit])


def _width(char: str) -> int:
    return len(char.encode())


@lru_cache(maxsize=2)
def counter_for(model_file: str) -> PrefixCounter:
    """One for all tasks of a worker, as what it remembers serves them all."""
    return PrefixCounter(model_file)


class _Steps(dict):
    """Steps of whole words, worked out on first use."""

    def __init__(self, inner, limit: int) -> None:
        super().__init__()
        self.inner, self.limit = inner, limit

    def __missing__(self, word: str) -> bytes:
        steps = np.diff(self.inner(word)).astype(np.int32).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = steps
        return steps


def prefix_table(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_chars, prefixes) of every row's whole text.

    ``prefixes`` holds the token count of every prefix, about a byte a character, and is meant to
    be stored. A null text counts as empty; repeated rows and null ids come back as they are; other
    columns are ignored; an empty table gives an empty result.
    """

    def build():
        counter = counter_for(model_file)

        def apply(ids, texts):
            texts = [t or "" for t in texts]
            return (
                ids,
                [len(t.encode()) for t in texts],
                [len(t) for t in texts],
                [pack_steps(counter.steps(t)) for t in texts],
            )

        return apply

    return by_batch(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
        build,
        "doc_id bigint, n_bytes bigint, n_chars bigint, prefixes binary",
    )


def within(table: DataFrame, limit: int | Column) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens) from a ``prefix_table``.

    ``fit_chars`` is the length in characters of the longest prefix within ``limit`` tokens, and
    ``fit_tokens`` what it costs. ``limit`` is a number or a column of ``table``; a null one is no
    limit, one below 0 is as 0. Null ``prefixes`` are those of an empty text.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)

    def apply(ids, sizes, blobs, limits):
        return (ids, sizes, *zip(*map(answer, blobs, limits)))

    return by_batch(
        table.select("doc_id", "n_bytes", "prefixes", limit.cast("bigint").alias("limit")),
        lambda: apply,
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, "
        "fit_tokens bigint",
    )


def tokens_at(table: DataFrame, places: Column) -> DataFrame:
    """(doc_id, places, n_tokens), from a ``prefix_table``: the token counts of the prefixes whose
    lengths in characters the array ``places`` of a row has.

    A place beyond the text counts as its end, one before it as its start; a null one, or a null
    array, has a null count.
    """

    def apply(ids, blobs, asked):
        found = []
        for blob, at in zip(blobs, asked):
            counts = counts_of(blob)
            last = len(counts) - 1
            found.append(
                at if at is None
                else [None if k is None else int(counts[min(max(k, 0), last)]) for k in at]
            )
        return ids, asked, found

    return by_batch(
        table.select("doc_id", "prefixes", places.cast("array<bigint>").alias("places")),
        lambda: apply,
        "doc_id bigint, places array<bigint>, n_tokens array<bigint>",
    )


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row's whole text.

    What ``within`` says of the ``prefix_table``, whose values are made and asked in one pass, text
    by text, and not kept; odd rows are as there.
    """

    def build():
        counter = counter_for(model_file)

        def apply(ids, texts):
            asked = [answer(pack_steps(counter.steps(t)), limit) for t in texts]
            sizes = [len((t or "").encode()) for t in texts]
            return (ids, sizes, *list(zip(*asked))[:3])

        return apply

    return by_batch(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
        build,
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint",
    )
