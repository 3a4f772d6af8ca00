"""Benchmark passages in documents, by counting shared q-grams in diagonal bands.

An item is cut into overlapping windows. If a window of m characters occurs somewhere with at
most e edits, the two share at least m + 1 - q * (e + 1) q-grams (the q-gram lemma), and these
lie within 2 * e + 1 neighbouring diagonals. So shared q-grams are counted in overlapping bands of
diagonals, bands below the bound are dropped, and the rest are verified by banded alignment.
Short windows lie so densely that any SHORT + STEP characters in a row contain one of them.
Beside them, RUN words in a row of an item, and items too short for windows, are found as they are.
The benchmark is taken in blocks of bounded size, each against every document where it lies, so
documents never move.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
WINDOW = 120  # characters at an item's end that are searched together
SHORT, STEP = 60, 20  # so are these, from every place that is a multiple of STEP
RUN = 13  # words in a row that are found wherever they stand
EDITS = 0.1  # edits allowed, as a share of a window's characters
LEAST = 20  # shorter items are searched without edits, as whole words
BLOCK_CHARS = 1_000_000  # characters of the benchmark searched at once
PIECE = 1 << 13  # characters of a long document looked at a time
SIEVE_BITS = 22
ALIGNED = 2048  # candidates aligned at once
POINTS_EACH = 1 << 12  # characters held that count as much as one


def normal(text: str | None) -> str:
    """Lower case, single blanks."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that starts at each code point."""
    if len(points) < Q:
        return np.zeros(0, dtype=np.uint64)
    folded = (points ^ (points >> np.uint32(8))).astype(np.uint8)  # q of them fill 64 bits
    n = len(folded) - Q + 1
    out = np.empty(n, dtype=np.uint64)
    for shift in range(Q):
        count = (n - shift + Q - 1) // Q
        if count > 0:
            out[shift::Q] = folded[shift : shift + count * Q].view(np.uint64)
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    return powers(base, 1 << bits), powers(pow(base, -1, 1 << 64), 1 << bits)


def hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each part of the text from a start to an end; equal parts have equal ones."""
    up, down = _powers(max(14, len(points).bit_length()))
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points * up[: len(points)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all RUN words in a row of a normalised text."""
    blanks = np.flatnonzero(points == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(points))
    return starts[: max(0, len(starts) - RUN + 1)], ends[RUN - 1 :]


# Scripts without blanks, where a word may stand beside any other letter.
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x30FF),
            (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


@cache
def _in_words() -> np.ndarray:
    """Whether a code point next to a word belongs to it."""
    out = np.array([unicodedata.category(chr(k))[0] in "LNM" for k in range(0x110000)])
    for first, last in UNSPACED:
        out[first : last + 1] = False
    out[ord("_")] = True
    return out


@dataclass
class Slices(Sequence):
    """Parts of one array, cut out when they are asked for."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.data[self.starts[k] : self.ends[k]]


@dataclass
class Windows:
    """The windows of a block of items, and where each q-gram stands in them.

    Runs of words and short items follow the windows; they have no edits and no q-grams.
    """

    items: list  # item of each window
    offsets: np.ndarray  # of the window in its item
    points: Slices
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that a match has at least
    known: np.ndarray  # distinct q-grams, sorted
    starts: np.ndarray  # of each one's occurrences below
    window: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    runs: tuple[np.ndarray, np.ndarray]  # sorted hashes of runs, and which they are
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of short items, by their length


def _sieved(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)


def prepare(rows: list[tuple]) -> Windows:
    """Windows of ``(item_id, text)`` rows."""
    texts = [(item, codes(normal(text))) for item, text in rows]
    data = np.concatenate([*[own for _, own in texts], np.zeros(0, np.uint32)])
    windows, runs, short = [], [], []
    begin = 0
    for item, own in texts:
        n = len(own)
        if n >= LEAST:
            last = max(0, n - SHORT)
            parts = [(k, min(n, k + SHORT)) for k in [*range(0, last, STEP), last]]
            if n > SHORT:  # those before it are two short windows
                parts.append((max(0, n - WINDOW), n))
            windows += [(item, begin, start, end) for start, end in parts]
        elif n:
            short.append((item, begin, 0, n))
        runs += [(item, begin, start, end) for start, end in zip(*(x.tolist() for x in word_runs(own)))]
        begin += n
    every = [*windows, *runs, *short]
    begins, offsets, ends = np.array([x[1:] for x in every], dtype=np.int64).reshape(-1, 3).T
    points = Slices(data, begins + offsets, begins + ends)
    sizes = (ends - offsets)[: len(windows)]
    # so few edits that the lemma's bound stays at one q-gram at least
    edits = np.minimum((sizes * EDITS).astype(np.int64), (sizes - Q) // Q)
    each = [grams(points[k]) for k in range(len(windows))]
    value = np.concatenate([*each, np.zeros(0, np.uint64)])
    window = np.repeat(np.arange(len(each)), [len(g) for g in each]).astype(np.int64)
    place = np.concatenate([*[np.arange(len(g)) for g in each], np.zeros(0, int)]).astype(np.int64)
    order = np.argsort(value, kind="stable")
    known, first = np.unique(value[order], return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
    sieve[_sieved(known)] = True

    own_hash = np.zeros(len(every), dtype=np.uint64)
    for k in range(len(windows), len(every)):
        own_hash[k] = hashes(points[k], np.array([0]), np.array([len(points[k])]))[0]

    def ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = numbers[np.argsort(own_hash[numbers], kind="stable")]
        return own_hash[numbers], numbers

    numbers = np.arange(len(windows) + len(runs), len(every))
    lengths = (ends - offsets)[numbers]
    return Windows(
        [x[0] for x in every], offsets, points, np.append(edits, np.zeros(len(runs) + len(short), int)),
        sizes + 1 - Q * (edits + 1),
        known, np.append(first, len(value)).astype(np.int64), window[order], place[order], sieve,
        ranked(np.arange(len(windows), len(windows) + len(runs))),
        {int(n): ranked(numbers[lengths == n]) for n in np.unique(lengths)},
    )


def align(
    patterns: np.ndarray, texts: list[np.ndarray], lows: np.ndarray, width: int, limit: int
) -> np.ndarray:
    """For each pattern, the fewest edits to any part of its text in a band of diagonals.

    The band starts at diagonal ``lows`` and is ``width`` wide; an alignment may start on any of
    these and may leave them by ``limit``. Patterns are rows of equal length, and one step fills one
    row of cells of them all. Those with more than ``limit`` edits everywhere are given up on the
    way; a result above ``limit`` says no more than that.
    """
    n, length = patterns.shape
    width += 2 * limit
    padded = np.full((n, width + length), 0xFFFFFFFF, dtype=np.uint32)  # matches nothing
    for own, text, low in zip(padded, texts, (lows - limit).tolist()):
        start, end = max(low, 0), min(low + width + length, len(text))
        if end > start:
            own[start - low : end - low] = text[start:end]
    out = np.full(n, limit + 1, dtype=np.int64)
    alive = np.arange(n)
    steps = np.arange(width, dtype=np.int16)
    row = np.zeros((n, width), dtype=np.int16)
    for k in range(length):
        new = row + (padded[:, k : k + width] != patterns[:, k : k + 1])
        np.minimum(new[:, :-1], row[:, 1:] + np.int16(1), out=new[:, :-1])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        row = new + steps
        if k & 7 == 7:
            near = row.min(axis=1) <= limit
            if not near.all():
                alive, row, padded, patterns = alive[near], row[near], padded[near], patterns[near]
                if not len(alive):
                    return out
    out[alive] = row.min(axis=1)
    return out


@dataclass
class Candidate:
    """A window that shares enough q-grams with a part of a document, in a band of diagonals."""

    number: int  # of the window
    low: int  # first diagonal of the band
    piece: int  # where the part starts in the document
    part: np.ndarray


def verify(found: list[Candidate], w: Windows) -> np.ndarray:
    """Edits of each candidate, all of one length and number of edits at once."""
    edits = np.zeros(len(found), dtype=np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, c in enumerate(found):
        groups.setdefault((len(w.points[c.number]), int(w.edits[c.number])), []).append(k)
    for (_, limit), own in groups.items():
        for start in range(0, len(own), ALIGNED):
            some = own[start : start + ALIGNED]
            edits[some] = align(
                np.stack([w.points[found[k].number] for k in some]),
                [found[k].part for k in some],
                np.array([found[k].low for k in some]),
                2 * (2 * limit + 1),
                limit,
            )
    return edits


def matches(texts: Iterable[np.ndarray], w: Windows) -> Iterator[list[tuple[int, int, int]]]:
    """For each normalised document, (window, place, edits) of verified windows, one per item.

    Candidates of many documents are aligned together.
    """
    held: list[tuple[np.ndarray, list[Candidate]]] = []
    size = 0
    for points in texts:
        held.append((points, list(_near(points, w))))
        size += len(held[-1][1]) + len(points) // POINTS_EACH
        if size >= ALIGNED:
            yield from _verified(held, w)
            held, size = [], 0
    yield from _verified(held, w)


def _verified(held, w: Windows) -> Iterator[list[tuple[int, int, int]]]:
    edits = iter(verify([c for _, found in held for c in found], w).tolist())
    for points, found in held:
        done, rows = set(), []
        for c in found:
            n = next(edits)
            if n <= w.edits[c.number] and w.items[c.number] not in done:
                done.add(w.items[c.number])
                rows.append((c.number, c.piece + max(c.low, 0), n))
        rows += _equal(points, w, done)
        yield rows


def _equal(points: np.ndarray, w: Windows, done: set) -> Iterator[tuple[int, int, int]]:
    """Runs of words, and short items that no letter or digit adjoins."""

    def found(begin, part, starts, ends, known, numbers):
        values = hashes(part, starts, ends)
        low = np.searchsorted(known, values)
        hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == values)
        for k in hit.tolist():
            own = part[starts[k] : ends[k]]
            for number in numbers[low[k] : np.searchsorted(known, values[k], "right")].tolist():
                if w.items[number] not in done and np.array_equal(w.points[number], own):
                    done.add(w.items[number])
                    yield number, begin + int(starts[k]), 0

    if len(w.runs[0]):
        starts, ends = word_runs(points)
        for k in range(0, len(starts), PIECE // 8):
            own, its = starts[k : k + PIECE // 8], ends[k : k + PIECE // 8]
            begin = int(own[0])
            yield from found(begin, points[begin : its[-1]], own - begin, its - begin, *w.runs)
    if w.short and len(points):
        free = np.concatenate([[True], ~_in_words()[points], [True]])  # from one before the text
        for piece in range(0, len(points), PIECE):
            part = points[piece : piece + PIECE + LEAST]
            for n, own in w.short.items():
                starts = np.arange(max(0, len(part) - n + 1))
                starts = starts[free[piece + starts] & free[piece + starts + n + 1]]
                yield from found(piece, part, starts, starts + n, *own)


def _near(points: np.ndarray, w: Windows) -> Iterator[Candidate]:
    """Windows that share enough q-grams to be within their edits."""
    if not len(w.known) or len(points) < Q:
        return
    for piece in range(0, len(points), PIECE):
        # neighbouring pieces share enough text for any match to lie in one of them whole
        part = points[piece : piece + PIECE + 4 * WINDOW]
        values = grams(part)
        at = np.flatnonzero(w.sieve[_sieved(values)])
        if not len(at):
            continue
        number = np.searchsorted(w.known, values[at])
        hit = number < len(w.known)
        hit[hit] = w.known[number[hit]] == values[at[hit]]
        at, number = at[hit], number[hit]
        if not len(at):
            continue
        counts = w.starts[number + 1] - w.starts[number]
        total = int(counts.sum())
        shift = w.starts[number] - (np.cumsum(counts) - counts)
        entry = np.arange(total) + np.repeat(shift, counts)
        window = w.window[entry]
        diagonal = np.repeat(at, counts) - w.place[entry] + WINDOW  # never negative
        step = 2 * w.edits[window] + 1
        bands = len(part) + 2 * WINDOW
        cell = window * bands + diagonal // step + 1
        # band b holds the diagonals of cells b and b + 1
        ranked = np.sort(cell)
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        own = np.diff(np.append(first, len(ranked)))
        cells = ranked[first]
        joined = np.append(cells[1:] == cells[:-1] + 1, False)
        shared = own + np.where(joined, np.append(own[1:], 0), 0)
        enough = shared >= w.least[cells // bands]
        # bands whose first cell is empty
        alone = ~np.concatenate([[False], joined[:-1]]) & (own >= w.least[cells // bands])
        band = np.union1d(cells[enough], cells[alone] - 1)
        if not len(band):
            continue
        # a place of the window counts once, however often its q-gram comes up in the band
        key = [
            cell[mine] * WINDOW + w.place[entry[mine]] - after * WINDOW
            for after in (0, 1)
            for mine in [np.flatnonzero(_among(band, cell - after))]
        ]
        key, shared = np.unique(np.unique(np.concatenate(key)) // WINDOW, return_counts=True)
        number = key // bands
        chosen = shared >= w.least[number]
        for n, b in zip(number[chosen].tolist(), (key % bands)[chosen].tolist(), strict=True):
            step = 2 * int(w.edits[n]) + 1
            yield Candidate(n, (b - 1) * step - WINDOW, piece, part)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Windows]:
    """The benchmark's windows, so many characters of it at a time."""
    rows = benchmark.select(
        F.col("item_id").cast("bigint"), F.col("text").cast("string")
    ).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k
        yield prepare([(r.item_id, r.text) for r in rows.where(block).orderBy("item_id").collect()])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_start, doc_start, edits) of every document with part of an item.

    One row per row of ``docs`` and item: the first window found, or else the first run of RUN
    words, where it starts in the item, about where in the normalised document, and its edits.
    Items under LEAST characters are found as they are, without letters or digits beside them.
    Null and empty texts have none.
    Items of one id count as one; a row that is repeated is reported as often; other columns
    are ignored; an empty table on either side gives an empty result.
    """
    schema = "doc_id bigint, item_id bigint, item_start bigint, doc_start bigint, edits bigint"
    names = [part.split()[0] for part in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(
        "text IS NOT NULL"
    )
    spark = docs.sparkSession
    out = None
    for windows in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(windows)  # of bounded size

        def run(batches, shared=shared):
            w = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = (codes(normal(t)) for t in batch.column(1).to_pylist())
                rows = [
                    (doc_id, w.items[k], int(w.offsets[k]), place, edits)
                    for doc_id, found in zip(ids, matches(texts, w), strict=True)
                    for k, place, edits in found
                ]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.int64()) for c in columns], names=names
                )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, with all their columns."""
    at = docs.columns.index("text")
    spark = docs.sparkSession
    for windows in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(windows)

        def run(batches, shared=shared):
            w = shared.value
            for batch in batches:
                texts = (codes(normal(t)) for t in batch.column(at).to_pylist())
                clean = [not found for found in matches(texts, w)]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
