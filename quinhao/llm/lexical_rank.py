"""Best documents for each of many items, by presence masks over an index of segments.

``build_index`` turns the documents of a task into segments: the terms of a few thousand documents
with the places and counts of each. ``rank`` brings every segment together with every block of
items. For one item and one segment, each term sets its bit in the masks of the documents that hold
it; documents with one mask are a group, whose scores are at most what the best document of each of
its terms would add up to. Groups are scored by descending bound, until the next bound is below the
score of the last place: what is left can't change the result, so it is exact.

Terms are runs of digits, ASCII letters and all other code points beyond ASCII, A to Z lower-cased.
``rank`` gives the rule of the scores.

Defined for every row: a null or blank text has no terms; each row of the documents is ranked for
itself, repeated ones too, and rows without an id come after equal ones with an id; rows of items
with one id are one item, whose terms add up, and so are items without an id; other columns are not
read. Without items or documents the result is empty.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, scratch, utf8_rows
from quinhao.operators.lookup import engine_broadcasts

SEGMENT_DOCS = 8192
SEGMENT_WORDS = 1 << 18  # a segment ends with the document that reaches this
BLOCK_TERMS = 20_000  # terms of items in a block, on average
MOST_BLOCKS = 8  # blocks that a task has scores of at once; beyond, it hands them on
STEP = 128  # documents of small groups that are scored at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_KEEP = bytes(range(0x80, 0x100)) + b"0123456789" + LOWER.encode()
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))

INDEX_SCHEMA = (
    "segment bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths binary,"
    " terms binary, dfs binary, places binary, counts binary, width int"
)
NAMES = [column.split()[0] for column in INDEX_SCHEMA.split(", ")]


def words(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(TABLE).split()


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of ``docs``: every document that has a term, with all its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number = count(first)
        ids, found, held, vocabulary = [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc_id, data in zip(names, utf8_rows(batch.column(1)), strict=True):
                terms = words(data.tobytes())
                if not terms:
                    continue
                ids.append(doc_id)
                numbered = map(vocabulary.__getitem__, terms)
                found.append(np.fromiter(numbered, np.int64, len(terms)))
                held += len(terms)
                if held >= SEGMENT_WORDS or len(ids) == SEGMENT_DOCS:
                    yield _segment(next(number), ids, found, vocabulary)
                    ids, found, held, vocabulary = [], [], 0, defaultdict(count().__next__)
        if ids:
            yield _segment(next(number), ids, found, vocabulary)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX_SCHEMA)


def _segment(
    number: int, ids: list[int | None], found: list[np.ndarray], vocabulary: dict[bytes, int]
) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in found], dtype=np.int64)
    place = np.repeat(np.arange(len(ids)), lengths)
    key, counts = np.unique(np.concatenate(found) * len(ids) + place, return_counts=True)
    term, place = np.divmod(key, len(ids))
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 8
    row = [
        number, len(ids), int(lengths.sum()), ids, lengths.tobytes(), b" ".join(vocabulary),
        np.bincount(term, minlength=len(vocabulary)).astype(np.int32).tobytes(),
        place.astype(np.uint16).tobytes(), counts.astype(f"u{width}").tobytes(), width,
    ]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 5 + [pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=NAMES
    )


class Segment:
    """A segment as a task reads it, with what the terms of items add to its documents' scores."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        terms = row["terms"].split(b" ")
        self.number_of = dict(zip(terms, range(len(terms)), strict=True))
        self.ends = np.cumsum(np.frombuffer(row["dfs"], np.int32).astype(np.int64))
        self.places = np.frombuffer(row["places"], np.uint16)
        self.counts = np.frombuffer(row["counts"], f"u{row['width']}")
        lengths = np.frombuffer(row["lengths"], np.int64).tolist()
        # Python's integers: the product may pass 64 bits
        self.damping = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], np.int64)
        self._parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def parts(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents with a term, ascending, and its part of their scores."""
        if term not in self._parts:
            own = slice(self.ends[term - 1] if term else 0, self.ends[term])
            places, tf = self.places[own], self.counts[own].astype(np.int64)
            part = 1_000_000_000 * tf // (1000 * tf + 8 * self.damping[places])
            self._parts[term] = places, part
        return self._parts[term]


class Best:
    """The ``k`` first of the documents seen for an item, by score and then by id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        new = [(-int(s), i is None, i or 0) for s, i in zip(scores, ids, strict=True) if s > 0]
        self.rows = sorted(self.rows + new)[: self.k]

    @property
    def floor(self) -> int:
        """A document with a lower score has no place any more."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1


def scan(segment: Segment, weights: dict[bytes, int], best: Best) -> int:
    """Score a segment's documents for one item; returns how many had to be scored."""
    known = [(segment.number_of[t], w) for t, w in weights.items() if t in segment.number_of]
    if not known:
        return 0
    held = [(*segment.parts(t), w) for t, w in known]
    masks = np.zeros((-(-len(held) // 64), len(segment.ids)), np.uint64)
    for k, (places, _, _) in enumerate(held):
        masks[k >> 6, places] |= np.uint64(1 << (k & 63))
    touched = np.flatnonzero(masks.any(axis=0))
    if len(masks) == 1:
        different, group = np.unique(masks[0, touched], return_inverse=True)
        different = different[None, :]
    else:
        different, group = np.unique(masks[:, touched], axis=1, return_inverse=True)
    group = group.reshape(-1)
    bound = np.zeros(different.shape[1], np.int64)
    for k, (_, part, weight) in enumerate(held):
        has = different[k >> 6] >> np.uint64(k & 63) & np.uint64(1)
        bound += has.astype(np.int64) * (weight * int(part.max()))
    order = np.argsort(-bound, kind="stable")
    members = touched[np.argsort(group, kind="stable")]
    sizes = np.bincount(group, minlength=len(bound))
    starts = np.cumsum(sizes) - sizes
    scored, at = 0, 0
    while at < len(order) and bound[order[at]] >= best.floor:
        end = at + 1  # a group that is large alone, or some that are small together
        held_docs = sizes[order[at]]
        while end < len(order) and held_docs + sizes[order[end]] <= STEP:
            held_docs += sizes[order[end]]
            end += 1
        chosen = [members[starts[g] : starts[g] + sizes[g]] for g in order[at:end]]
        docs = np.concatenate(chosen)
        scores = np.zeros(len(docs), np.int64)
        for places, part, weight in held:
            near = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            scores += np.where(places[near] == docs, weight * part[near], 0)
        worth = np.flatnonzero(scores >= best.floor)
        best.add(scores[worth], [segment.ids[d] for d in docs[worth]])
        scored, at = scored + len(docs), end
    return scored


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, uses) of all items."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return (
        items.select(
            F.col("item_id").cast("bigint"),
            F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"),
        )
        .groupBy("item_id", "term")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def beside(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every segment with every block, joined by lanes.

    Blocks that the engine's size estimate lets it broadcast come to where the segments lie. More of
    them are copied once for each task, and segments are dealt out to the tasks.
    """
    lanes = 1
    if not engine_broadcasts(blocks):
        lanes = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("segment"), F.lit(lanes)).cast("int")
    copied = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return segments.withColumn("lane", lane).join(copied, "lane").drop("lane")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, with scores above 0.

    With N documents that have a term, L their terms, n those of one document, df the documents that
    hold a term and tf its uses in one, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    adds w * (10**9 * tf div (1000 * tf + 8 * (25 + 75 * n * N div L))) to a document's score, for
    each of its uses in the item. ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    with scratch(docs.sparkSession):
        index = materialize(build_index(docs), "index")
        terms = materialize(item_terms(items), "item-terms")
        return materialize(_ranked(index, terms, k), "ranks", keep=True)


def _ranked(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()  # two numbers
    n_docs, n_terms = (int(x or 0) for x in totals)
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    blocked = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    held = materialize(
        blocked.groupBy("block").agg(F.collect_set("term").alias("wanted")), "vocabularies"
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sought = None, frozenset()
        for batch in batches:
            for row, wanted in _rows(batch):
                if row["block"] != block:
                    block, sought = row["block"], frozenset(t.encode() for t in wanted())
                terms = zip(row["terms"].split(b" "), np.frombuffer(row["dfs"], np.int32))
                found = [(t.decode(), int(df)) for t, df in terms if t in sought]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(found), pa.int64()),
                        pa.array([t for t, _ in found], pa.string()),
                        pa.array([df for _, df in found], pa.int64()),
                    ],
                    names=["block", "term", "df"],
                )

    used = (
        beside(index.select("segment", "terms", "dfs"), held)
        .mapInArrow(frequencies, "block bigint, term string, df bigint")
        .groupBy("block", "term")
        .agg(F.sum("df").alias("df"))
    )
    queries = materialize(
        blocked.join(used, ["block", "term"])
        .groupBy("block")
        .agg(F.collect_list(F.struct("item_id", "term", "uses", "df")).alias("wanted")),
        "queries",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted: dict[int, dict] = {}
        best: dict[int, dict] = {}
        segment = number = None
        for batch in batches:
            for row, wanted in _rows(batch):
                block = row["block"]
                if block not in best:
                    if len(best) == MOST_BLOCKS:
                        yield _best_rows(best)
                        weighted, best = {}, {}
                    weighted[block] = _weights(wanted(), n_docs)
                    best[block] = {item: Best(k) for item in weighted[block]}
                if row["segment"] != number:
                    segment, number = Segment(row, n_docs, n_terms), row["segment"]
                for item, weights in weighted[block].items():
                    scan(segment, weights, best[block][item])
        if best:
            yield _best_rows(best)

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (  # each task keeps its own best rows of an item before any move
        beside(index, queries)
        .mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, Callable[[], list]]]:
    """One row at a time: its segment's values, and a call that gives what its block wants."""
    wanted = batch.column("wanted")
    names = [n for n in batch.schema.names if n != "wanted"]
    for i in range(batch.num_rows):
        values = {n: batch.column(n)[i].as_py() for n in names}
        yield values, lambda i=i: wanted[i].as_py()


def _weights(wanted: list[dict], n_docs: int) -> dict[int | None, dict[bytes, int]]:
    """What each term of each item counts for; terms of no weight are left out."""
    items: dict[int | None, dict[bytes, int]] = defaultdict(dict)
    for row in wanted:
        weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
        if weight > 0:
            items[row["item_id"]][row["term"].encode()] = weight * row["uses"]
    return items


def _best_rows(best: dict[int, dict]) -> pa.RecordBatch:
    rows = [
        (item, None if missing else doc_id, -score)
        for block in best.values()
        for item, found in block.items()
        for score, missing, doc_id in found.rows
    ]
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"]
    )
