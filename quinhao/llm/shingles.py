"""Hashed word shingles of whole texts, from their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quinhao.llm.common import mix

WORDS = 5  # words in a shingle
PIECE = 1 << 20  # bytes of a long text hashed at a time
_BASE = 0x9E3779B97F4A7C15
_ODD = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
        0xA0761D6478BD642F]

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running hashes: that of data[i:j] is (h[j] - h[i]) times the base's inverse ** i."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def _pieces(data: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of pieces of about PIECE bytes that no word crosses."""
    start = 0
    while start < len(data):
        end = start + PIECE
        if end < len(data):
            after = np.flatnonzero(blank[end : end + PIECE])
            while not len(after) and end < len(data):
                end += PIECE
                after = np.flatnonzero(blank[end : end + PIECE])
            end = min(len(data), end + int(after[0]) if len(after) else len(data))
        yield start, min(end, len(data))
        start = end


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash per word, words being parted by the six ASCII blanks, with A-Z lower-cased."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out = []
    for start, end in _pieces(data, blank):
        part, gap = data[start:end], blank[start:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        first, last = edges[::2], edges[1::2]
        lower = part + ((part >= 65) & (part <= 90)) * np.uint8(32)
        sums = prefix_hashes(lower)
        _, down = powers(len(part) + 1)
        value = (sums[last] - sums[first]) * down[first]
        out.append(mix(value + (last - first).astype(np.uint64) * np.uint64(_ODD[0])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; fewer words make one shingle, no words none."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        total = np.full(1, n, dtype=np.uint64)
        for k in range(n):
            total = mix(total + words[k : k + 1] * np.uint64(_ODD[k]))
        return total
    total = np.full(n - WORDS + 1, WORDS, dtype=np.uint64)
    for k in range(WORDS):
        total += words[k : n - WORDS + 1 + k] * np.uint64(_ODD[k])
    return np.unique(mix(total))
