"""Byte-level pair encoding with a rank queue made of hierarchical bitmaps, and decoding.

The queue holds, for each merge rank, the linked-list positions whose pair has that rank. Which
ranks have positions is kept in a bitmap of 256-bit words under a summary bitmap, so the lowest
rank is two find-first-set steps away however long the pre-token is. A merge changes the pairs
of its neighbours; their old entries stay behind and are skipped when they come up. A pre-token
of n bytes takes O(n log n), where rescanning all pairs takes O(n^2).
"""

from __future__ import annotations

import base64
from collections.abc import Mapping
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import by_batch

MEMO_TOKENS = 1_000_000  # pre-tokens remembered by a worker; beyond that it starts anew
MEMO_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position."""

    __slots__ = ("summary", "words", "buckets")

    def __init__(self) -> None:
        self.summary = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 8
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 255)
        self.summary |= 1 << word

    def pop(self) -> tuple[int, int]:
        """(rank, position), or (-1, -1) when nothing is left."""
        if not self.summary:
            return -1, -1
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = (word << 8) + low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            bits ^= low
            self.words[word] = bits
            if not bits:
                self.summary &= self.summary - 1
        return rank, position


def merge(piece: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # linked list over start positions; n ends it
    before = list(range(-1, n - 1))
    pair = [-1] * n  # current rank of the pair that starts here; -1: none, or merged away
    queue = RankQueue()
    for at in range(n - 1):
        rank = ranks.get(piece[at : at + 2])
        if rank is not None:
            pair[at] = rank
            queue.push(rank, at)
    while True:
        rank, at = queue.pop()
        if rank < 0:
            break
        if pair[at] != rank:
            continue  # stale: this pair has changed since
        gone = after[at]
        pair[gone] = -1
        end = after[at] = after[gone]
        if end < n:
            before[end] = at
            new = ranks.get(piece[at : after[end]])
        else:
            new = None
        if new is None:
            pair[at] = -1
        else:
            pair[at] = new
            queue.push(new, at)
        left = before[at]
        if left >= 0:
            new = ranks.get(piece[left:end])
            if new is None:
                pair[left] = -1
            else:
                pair[left] = new
                queue.push(new, left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Memo(dict):
    """Ids of pre-tokens as bytes, worked out on first use."""

    def __init__(self, ranks: Mapping[bytes, int], limit: int) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, token: str) -> bytes:
        ids = np.asarray(merge(token.encode(), self.ranks), dtype="<u4").tobytes()
        if len(token) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[token] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; special tokens are ordinary text."""

    def __init__(self, ranks_file: str, pattern: str, memo: int = MEMO_TOKENS) -> None:
        import regex

        self.ranks = read_ranks(ranks_file)
        self.findall = regex.compile(pattern).findall
        self._ids = _Memo(self.ranks, memo)
        self._bytes: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self._bytes[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._ids.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self._bytes.__getitem__, tokens))


@lru_cache(maxsize=2)
def codec_for(ranks_file: str, pattern: str) -> Codec:
    """One for all tasks of a worker, as what it remembers serves them all."""
    return Codec(ranks_file, pattern)


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row's whole text.

    A null text counts as empty and gives no ids; repeated rows and null ids come back as they
    are; other columns are ignored; an empty table gives an empty result.
    """

    def build():
        codec = codec_for(ranks_file, pattern)

        def apply(doc_ids, texts):
            ids = [codec.encode(t) if t else b"" for t in texts]
            return doc_ids, [len(x) // 4 for x in ids], ids, [codec.decode(x) for x in ids]

        return apply

    return by_batch(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
        build,
        "doc_id bigint, n_tokens bigint, ids binary, decoded binary",
    )


def round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_decode`` gives."""
    return encode_decode(docs, ranks_file, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
