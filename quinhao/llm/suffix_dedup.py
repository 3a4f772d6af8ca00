"""Removal of repeated byte strings by longest previous factors over a distributed suffix order.

A byte goes if it is covered by a string of ``length`` bytes that also starts at an earlier place
(``keep="first"``) or at any other place (``keep="none"``). So only the order of suffixes by
their first ``length`` bytes matters, and which of them share these: the longest previous factor
of a suffix is that long just when its previous smaller position in suffix order, the nearest
suffix before it that starts earlier, shares them, or its next smaller position does.

Suffixes are ranked by a fingerprint of their first bytes, which puts equal ones side by side,
and cut into buckets, each a range of that order. Only suffixes that may have a partner are
ranked. Every window of ``length`` bytes is assigned to its minimizer, the K-byte string in it of
least hash; equal windows have equal minimizers at the same place.

1. Tasks list the minimizers of their documents, each with the run of windows that it owns and a
   hash of all text under them. Where both have a partner, the whole run is repeated: copies
   never get to the ranking. Where a minimizer has no partner, none of its windows has.
2. What is left are runs at the edges of repeated passages. Their windows are ranked, one by one,
   and previous and next smaller positions tell which have an earlier or a later match.
3. Documents get their repeated windows back, and the bytes under them are removed.

Entries travel packed (``packed``). Of the many entries of one key in a task, two are shipped; the
others are known to have a partner at once. So a passage that a third of all documents share is
a few entries for each task in its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, mix, scratch, utf8_rows
from quinhao.llm.packed import (
    MOST_OWNERS,
    SCHEMA,
    bucket_bits,
    pack,
    pack_replies,
    reduce_buckets,
    reply_bits,
    split_key,
    unpack,
)
from quinhao.llm.shingles import powers, prefix_hashes

LENGTH = 400  # bytes of a repeated string
K = 256  # bytes of a minimizer
PIECE = 1 << 20  # windows of a long document looked at a time
FLUSH = 1_000_000  # entries that a task packs at a time
CROWD = 64  # runs of one minimizer in a task, beyond which they go straight to the ranking
GONE, RANKED = 1, 2  # what a run is told: all its windows are repeated; rank its windows

OWNER = np.dtype([("id", "<i8"), ("tag", "<u4")])
RUN = np.dtype([("key", "<u4"), ("text", "<u4"), ("start", "<u4"), ("more", "<u2"),
                ("many", "u1"), ("owner", "<u2")])
TOLD = np.dtype([("id", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("more", "<u2"), ("what", "u1")])
SUFFIX = np.dtype([("key", "<u8"), ("start", "<u4"), ("owner", "<u2")])
MARK = np.dtype([("start", "<u4"), ("more", "<u2"), ("what", "u1")])


def runs(data: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimizer hash, text hash, first window, windows after it) of a document's runs.

    Long documents come in pieces; runs at their borders are cut, which only sends them to the
    ranking.
    """
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[base : base + PIECE + length - 1]
        sums = prefix_hashes(part)
        _, down = powers(len(part) + 1)
        grams = mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1])
        width = length - k + 1  # minimizers that a window may have
        # least hash first, then least place
        rank = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        blocks = -(-len(rank) // width)
        grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(rank)] = rank
        grid = grid.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        more = np.diff(np.append(start, windows)) - 1
        end = start + more + length
        text = (sums[end] - sums[start]) * down[start]
        shape = (place[start] - start) * 65536 + more
        yield grams[place[start]], mix(text + mix(shape.astype(np.uint64))), start + base, more


def window_hashes(data: np.ndarray, start: int, more: int, length: int) -> np.ndarray:
    """Fingerprints of the suffixes from ``start`` to ``start + more``, of ``length`` bytes."""
    part = data[start : start + more + length]
    sums = prefix_hashes(part)
    _, down = powers(more + 1)
    return mix((sums[length:] - sums[: more + 1]) * down)


def smaller_positions(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the previous and next smaller place for every rank of a suffix order, -1 if none.

    All ranks step together to the neighbour's own answer until they meet a smaller place.
    """
    n = len(place)
    found = []
    for values in (place, place[::-1]):
        at = np.arange(n) - 1
        open_ends = np.flatnonzero(at >= 0)
        while len(open_ends):
            open_ends = open_ends[values[at[open_ends]] >= values[open_ends]]
            at[open_ends] = at[at[open_ends]]
            open_ends = open_ends[at[open_ends] >= 0]
        found.append(at)
    after = found[1][::-1]
    return found[0], np.where(after < 0, -1, n - 1 - after)


def _identity() -> tuple[Column, Column]:
    """What tells rows apart: the id, and bits of the text's hash."""
    least = F.lit(-(1 << 63))
    tag = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.coalesce(F.col("doc_id").cast("bigint"), least).alias("id"), tag.alias("tag")


def _told(owners: np.ndarray, start, more, what) -> np.ndarray:
    out = np.empty(len(owners), dtype=TOLD)
    out["id"], out["tag"] = owners["id"], owners["tag"]
    out["start"], out["more"], out["what"] = start, more, what
    return out


def _pack_told(told: np.ndarray, bits: int) -> pa.RecordBatch:
    key = mix(told["id"].view(np.uint64) + mix(told["tag"].astype(np.uint64)))
    return pack_replies((key >> np.uint64(64 - bits)).astype(np.int64), told)


def _groups(*fields: np.ndarray) -> np.ndarray:
    """Where a new group starts among sorted fields."""
    new = np.ones(len(fields[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for field in fields:
            new[1:] |= field[1:] != field[:-1]
    return new


def _rank_in(new: np.ndarray) -> np.ndarray:
    """Number of each member in its group."""
    first = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))


def _emit_runs(
    docs: DataFrame, bits: int, told_bits: int, length: int, k: int, first: bool
) -> DataFrame:
    def flush(parts: list, owners: list) -> Iterator[pa.RecordBatch]:
        names = np.array(owners, dtype=OWNER)
        key, text, start, more = (np.concatenate([p[i] for p in parts]) for i in range(4))
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((start, names["tag"][owner], names["id"][owner], text, key))
        key, text, start, more, owner = (x[order] for x in (key, text, start, more, owner))
        if first:  # repeated rows are one document
            new = _groups(key, text, names["id"][owner], names["tag"][owner], start)
            key, text, start, more, owner = (x[new] for x in (key, text, start, more, owner))
        new_text = _groups(key, text)
        copy = ~new_text
        many = np.zeros(len(key), dtype=bool)
        many[:-1] = copy[1:]
        many &= new_text
        told = [_told(names[owner[copy]], start[copy], more[copy], GONE)]
        key, text, start, more, owner, many = (
            x[new_text] for x in (key, text, start, more, owner, many)
        )
        # a minimizer of very many runs: two are shipped, all are ranked
        new_key = _groups(key)
        size = np.diff(np.append(np.flatnonzero(new_key), len(key)))
        crowd = np.repeat(size > CROWD, size) & (_rank_in(new_key) >= 2)
        what = RANKED + (GONE * many[crowd] if not first else 0)
        told.append(_told(names[owner[crowd]], start[crowd], more[crowd], what))
        yield _pack_told(np.concatenate(told), told_bits)
        ship = ~crowd
        bucket, short = split_key(key[ship], bits)
        entries = np.empty(len(short), dtype=RUN)
        entries["key"], entries["text"] = short, (text[ship] >> np.uint64(32)).astype(np.uint32)
        entries["start"], entries["more"], entries["many"] = start[ship], more[ship], many[ship]
        owner = owner[ship]
        for part in range(0, len(names), MOST_OWNERS):
            mine = (owner >= part) & (owner < part + MOST_OWNERS)
            own = entries[mine]
            own["owner"] = owner[mine] - part
            yield pack(bucket[mine], own, names[part : part + MOST_OWNERS])

    def run(batches):
        parts, owners, held = [], [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, tag, data in zip(ids, tags, utf8_rows(batch.column(2))):
                for part in runs(data, length, k):
                    parts.append(part)
                    owners.append((name, tag))
                    held += len(part[0])
                if held >= FLUSH:
                    yield from flush(parts, owners)
                    parts, owners, held = [], [], 0
        if parts:
            yield from flush(parts, owners)

    rows = docs.select(*_identity(), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def _match_runs(table: pa.Table, bits: int, first: bool) -> pa.RecordBatch:
    """What the runs of a bucket are told."""
    entries, owners, told = unpack(table, RUN, OWNER, TOLD)
    order = np.lexsort(
        (entries["start"], owners["tag"], owners["id"], entries["text"], entries["key"])
    )
    entries, owners = entries[order], owners[order]
    if first:
        new = _groups(
            entries["key"], entries["text"], owners["id"], owners["tag"], entries["start"]
        )
        entries, owners = entries[new], owners[new]
    new_text = _groups(entries["key"], entries["text"])
    new_key = _groups(entries["key"])
    # a text has copies if two entries have it, or one from a task that saw it twice
    number = np.cumsum(new_text) - 1
    copies = np.bincount(number, weights=1 + entries["many"]) if len(number) else np.zeros(0)
    texts = np.bincount(np.cumsum(new_key) - 1, weights=new_text) if len(number) else np.zeros(0)
    gone = ~new_text if first else (copies > 1)[number]
    other = (texts > 1)[np.cumsum(new_key) - 1] if len(number) else np.zeros(0, bool)
    # one run of each text is ranked if its minimizer has other texts too
    what = GONE * gone + RANKED * (new_text & other)
    tell = what > 0
    mine = _told(owners[tell], entries["start"][tell], entries["more"][tell], what[tell])
    return _pack_told(np.concatenate([told, mine]), bits)


_MARKS = "id bigint, tag bigint, marks binary"


def _marks(table: pa.Table) -> pa.RecordBatch:
    """One row per document, with all that its runs were told."""
    _, _, told = unpack(table, RUN, OWNER, TOLD)
    told = told[np.lexsort((told["start"], told["tag"], told["id"]))]
    first = np.flatnonzero(_groups(told["id"], told["tag"]))
    marks = np.empty(len(told), dtype=MARK)
    for field in MARK.names:
        marks[field] = told[field]
    ends = np.append(first, len(told))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(told["id"][first]),
            pa.array(told["tag"][first].astype(np.int64)),
            pa.array([marks[a:b].tobytes() for a, b in zip(first, ends[1:])], type=pa.binary()),
        ],
        names=["id", "tag", "marks"],
    )


def _emit_suffixes(
    rows: DataFrame, bits: int, told_bits: int, length: int, first: bool
) -> DataFrame:
    """Packed suffixes of the runs that are to be ranked, of ``rows(id, tag, marks, text)``."""

    def flush(keys: list, starts: list, owners: list) -> Iterator[pa.RecordBatch]:
        names = np.array(owners, dtype=OWNER)
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        key, start = np.concatenate(keys), np.concatenate(starts)
        order = np.lexsort((start, names["tag"][owner], names["id"][owner], key))
        key, start, owner = key[order], start[order], owner[order]
        if first:
            new = _groups(key, names["id"][owner], names["tag"][owner], start)
            key, start, owner = key[new], start[new], owner[new]
        rank = _rank_in(_groups(key))
        # suffixes that a task has more than twice: their partners are here
        known = rank >= (1 if first else 2)
        yield _pack_told(_told(names[owner[known]], start[known], 0, GONE), told_bits)
        key, start, owner = key[~known], start[~known], owner[~known]
        entries = np.empty(len(key), dtype=SUFFIX)
        entries["key"], entries["start"] = key, start
        bucket, _ = split_key(key, bits)
        for part in range(0, len(names), MOST_OWNERS):
            mine = (owner >= part) & (owner < part + MOST_OWNERS)
            own = entries[mine]
            own["owner"] = owner[mine] - part
            yield pack(bucket[mine], own, names[part : part + MOST_OWNERS])

    def run(batches):
        keys, starts, owners, held = [], [], [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for name, tag, blob, data in zip(*columns, utf8_rows(batch.column(3))):
                for start, more, what in np.frombuffer(blob, dtype=MARK).tolist():
                    if what & RANKED:
                        keys.append(window_hashes(data, start, more, length))
                        starts.append(np.arange(start, start + more + 1))
                        owners.append((name, tag))
                        held += more + 1
                if held >= FLUSH:
                    yield from flush(keys, starts, owners)
                    keys, starts, owners, held = [], [], [], 0
        if keys:
            yield from flush(keys, starts, owners)

    return rows.select("id", "tag", "marks", "text").mapInArrow(run, SCHEMA)


def _match_suffixes(table: pa.Table, bits: int, first: bool) -> pa.RecordBatch:
    """Repeated windows of a bucket, from longest previous (and next) factors."""
    entries, owners, told = unpack(table, SUFFIX, OWNER, TOLD)
    # suffix order; equal suffixes by their place, that is document and start
    order = np.lexsort((entries["start"], owners["tag"], owners["id"], entries["key"]))
    entries, owners = entries[order], owners[order]
    if first:
        new = _groups(entries["key"], owners["id"], owners["tag"], entries["start"])
        entries, owners = entries[new], owners[new]
    # suffixes that equal no neighbour in the order have no match
    new = np.append(_groups(entries["key"]), True)
    pair = ~(new[:-1] & new[1:])
    entries, owners = entries[pair], owners[pair]
    by_place = np.lexsort((np.arange(len(entries)), entries["start"], owners["tag"], owners["id"]))
    place = np.empty(len(entries), dtype=np.int64)
    place[by_place] = np.arange(len(entries))
    key = entries["key"]
    matched = np.zeros(len(key), dtype=bool)
    for at in smaller_positions(place):  # of the longest previous factor, one of these is a match
        there = np.flatnonzero(at >= 0)
        matched[there] |= key[at[there]] == key[there]
        if not first:  # so is, for the next factor, whoever found it
            matched[at[there[key[at[there]] == key[there]]]] = True
    mine = _told(owners[matched], entries["start"][matched], 0, GONE)
    return _pack_told(np.concatenate([told, mine]), bits)


def repeats(
    docs: DataFrame, length: int = LENGTH, keep: str = "first", k: int | None = None
) -> DataFrame:
    """(id, tag, marks): the repeated windows of each document that has some."""
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    first = keep == "first"
    k = k or max(1, length * K // LENGTH)
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    bytes_in = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    entries = 2 * bytes_in // (length - k + 2)  # two minimizers a window's width, on average
    bits, back = bucket_bits(entries, partitions), reply_bits(entries)

    def match_runs(table: pa.Table) -> pa.RecordBatch:
        return _match_runs(table, back, first)

    keyed = docs.select(*_identity(), text.alias("text")).where("text IS NOT NULL")
    with scratch(spark):
        told = reduce_buckets(_emit_runs(docs, bits, back, length, k, first), match_runs)
        marks = materialize(reduce_buckets(told, _marks, _MARKS), "marks")
        rows = keyed.join(marks, ["id", "tag"])
        size = marks.agg(F.sum(F.octet_length("marks"))).first()[0] or 0
        windows = size // MARK.itemsize * (length - k) // 4
        bits, ranked_back = bucket_bits(windows, partitions), reply_bits(windows)

        def match_suffixes(table: pa.Table) -> pa.RecordBatch:
            return _match_suffixes(table, ranked_back, first)

        suffixes = _emit_suffixes(rows, bits, ranked_back, length, first)
        found = reduce_buckets(reduce_buckets(suffixes, match_suffixes), _marks, _MARKS)
        both = materialize(marks.unionByName(found), "marks", keep=True)
    return both.groupBy("id", "tag").agg(F.collect_list("marks").alias("marks"))


def covered(blobs: list[bytes], length: int) -> np.ndarray:
    """Starts and ends, in pairs, of the maximal runs of bytes under repeated windows."""
    marks = np.frombuffer(b"".join(blobs), dtype=MARK)
    marks = np.sort(marks[(marks["what"] & GONE) > 0], order="start")
    if not len(marks):
        return np.zeros((0, 2), dtype=np.int64)
    start = marks["start"].astype(np.int64)
    end = np.maximum.accumulate(start + marks["more"] + length)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[new], end[np.append(new[1:] - 1, len(end) - 1)]], axis=1)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """(doc_id, n_bytes, kept, text, starts, ends) of every row: its bytes without repeated
    strings, these as text, and the removed runs.

    Matches lie within documents, the same one included, and are judged on the input. A null text
    counts as empty. Repeated rows come back as they are; for ``keep="first"`` they are one
    document, for ``"none"`` each other's copies, as are equal texts without an id. Other columns
    are ignored; an empty table gives an empty result. ``kept`` need not be valid UTF-8; ``text``
    has the characters that are kept whole. Fingerprints have 64 bits.
    """
    marks = repeats(docs, length, keep)
    keyed = docs.select(F.col("doc_id").cast("bigint"), *_identity(), F.col("text").cast("string"))
    rows = keyed.join(marks, ["id", "tag"], "left").select("doc_id", "text", "marks")

    def run(batches):
        for batch in batches:
            out = []
            for data, blobs in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
                cut = covered(blobs or [], length)
                ends = np.concatenate([[0], cut[:, 1]]).tolist()
                starts = np.concatenate([cut[:, 0], [len(data)]]).tolist()
                whole = data.tobytes()
                parts = [whole[a:b] for a, b in zip(ends, starts)]
                text = "".join(part.decode("utf-8", "ignore") for part in parts)
                out.append((len(data), b"".join(parts), text, cut[:, 0], cut[:, 1]))
            places = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.binary(), pa.string(), places, places]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "n_bytes", "kept", "text", "starts", "ends"],
            )

    places = "starts array<bigint>, ends array<bigint>"
    schema = f"doc_id bigint, n_bytes bigint, kept binary, text string, {places}"
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) without any repeated string."""
    cleaned = dedup_bytes(docs, length, keep="none")
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "text",
    )
