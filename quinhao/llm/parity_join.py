"""Near-duplicate join on word shingles by parity sketches.

Two sets are linked when their Jaccard similarity is 3/4 or more. Linked sets of sizes a and b
differ in at most (a + b) / 7 elements. The universe of shingles is cut into parts by hash, and a
set's sketch holds, for each part, the exclusive-or of the hashes it has there. An element that
only one set has changes one part, so the number of parts that differ, the Hamming distance of
the sketches, never exceeds the symmetric difference.

1. Pigeonhole. In each size band the parts are so many that linked sets must agree in parts
   where they have something: a set with N non-empty parts in at least N - n // 3 of them. Each
   task ships the parts of its sets, packed by hash, and learns how many of them another set of
   the band has too. A set with too few is linked with nothing; this drops most of a corpus.
   Sets with too few non-empty parts are compared by single shingles instead.
2. The same count over single shingles among the sets that are left: a set needs 3/4 of its own
   shared.
3. Candidates are joined on parts of their sketches in a band. As linked sets agree in N - n // 3
   parts, they agree on one of the n // 3 + 1 rarest parts of each, so only these are joined; how
   rare a part is, is read off a table of counters of fixed size. Sets with too few parts are
   joined on all of them, and on their n - ceil(3n/4) + 1 rarest shingles. Every set takes the
   least doc_id that it meets on MEETINGS of these keys, those of least hash, as its label, and
   then the label of that document's set. Sets of one label are compared with each other in
   blocks, where each travels once; pairs of different labels that meet on any key, which are
   few, are listed. Pairs are dropped by size and by the Hamming distance of bit sketches, and
   what is left is verified on whole sets.

Sets that are equal are one class throughout. A key that many sets of a task have is shipped for
two of them, as the task itself knows that they all share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, mix, scratch, utf8_rows
from quinhao.llm.components import components
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
from quinhao.llm.shingles import shingle_set

PARTS = 0.58  # parts of a band's sketch, in elements of its largest sets but a third
LEAST_SIZE = 3  # smaller sets are linked with equal ones only
FLUSH = 500_000  # keys that a task packs at a time
ENTRY = np.dtype([("key", "<u4"), ("owner", "<u2")])
OWNER = np.dtype([("set", "<i8"), ("unit", "u1"), ("need", "<u2")])
REPLY = np.dtype([("set", "<i8"), ("unit", "u1"), ("need", "<u4"), ("count", "<u4")])
SINGLES = 4  # added to the unit of a band for sets that are compared by single shingles


def needed(n: int) -> int:
    """Elements of a set of n that a linked set has too, at least."""
    return -(-3 * n // 4)


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that stand for a set."""
    with np.errstate(over="ignore"):
        first = mix(np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))]))
        second = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(first.view(np.int64)[0]), int(np.array([second]).view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(unit, need, keys) of a set in each band where it may meet linked ones.

    Band j holds sizes from 2**j on, and those of the next band that a linked set of band j may
    have; unit 0 is the set's own band, unit 1 the one below.
    """
    n = len(shingles)
    own = n.bit_length() - 1
    for unit, band in ((0, own), (1, own - 1)):
        if unit and 3 * n >= 4 << own:
            continue
        parts = np.uint64(int(PARTS * (2 << band)) + 1)
        # the shingles are sorted, so those of a part are neighbours
        part = ((shingles >> np.uint64(32)) * parts) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word = np.bitwise_xor.reduceat(shingles, first)
        keys = mix(word + mix(part[first] + np.uint64(band << 40)))
        spare = len(first) - n // 3
        if spare > 0:
            yield unit, spare, keys
        else:
            # a linked set with enough parts has one in common; two without meet by shingles
            yield unit, 1, keys
            single = mix(shingles ^ np.uint64((band + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
            yield unit + SINGLES, needed(n), single


def single_keys(shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    yield 0, needed(len(shingles)), mix(shingles)


def _emit(
    sets: Iterator[tuple[int, np.ndarray]],
    keys_of: Callable[[np.ndarray], Iterator[tuple[int, int, np.ndarray]]],
    bits: int,
    told_bits: int,
) -> Iterator[pa.RecordBatch]:
    """Packed rows of the keys of ``(set, shingles)``, and replies known at once."""
    owners: list[tuple[int, int, int]] = []
    keys: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def flush():
        nonlocal owners, keys, held, seen
        names = np.array(owners, dtype=OWNER)
        by_set = np.argsort(names["set"], kind="stable")
        names, own = names[by_set], [keys[k] for k in by_set.tolist()]
        owners, keys, held, seen = [], [], 0, set()
        key = np.concatenate(own)
        owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(k) for k in own])
        del own
        order = np.argsort(key, kind="stable")  # of a key, by set
        key, owner = key[order], owner[order]
        del order
        known = np.zeros(len(key), dtype=bool)
        known[2:] = key[2:] == key[:-2]  # two others of this task have the key: shared
        if known.any():
            counts = np.bincount(owner[known], minlength=len(names))
            told = np.flatnonzero(counts)
            replies = np.empty(len(told), dtype=REPLY)
            for field in ("set", "unit", "need"):
                replies[field] = names[field][told]
            replies["count"] = counts[told]
            yield _pack_replies(replies, told_bits)
        key, owner = key[~known], owner[~known]
        # numbers of owners may pass 16 bits before a row has its own
        for part in range(0, len(names), MOST_OWNERS):
            mine = (owner >= part) & (owner < part + MOST_OWNERS)
            bucket, short = split_key(key[mine], bits)
            entries = np.empty(len(short), dtype=ENTRY)
            entries["key"], entries["owner"] = short, owner[mine] - part
            del mine, short
            yield pack(bucket, entries, names[part : part + MOST_OWNERS])

    for name, shingles in sets:
        if len(shingles) < LEAST_SIZE or name in seen:
            continue  # a task ships equal sets once
        seen.add(name)
        for unit, need, own in keys_of(shingles):
            owners.append((name, unit, min(need, 65_535)))  # less for very large sets
            keys.append(own)
            held += len(own)
        if held >= FLUSH:
            yield from flush()
    if owners:
        yield from flush()


def _count_shared(table: pa.Table, bits: int) -> pa.RecordBatch:
    """Replies with the number of an owner's keys in this bucket that other sets have too."""
    entries, owners, replies = unpack(table, ENTRY, OWNER, REPLY)
    # equal sets of several tasks are one
    order = np.lexsort((owners["set"], entries["key"]))
    key, owners = entries["key"][order], owners[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owners["set"][1:] != owners["set"][:-1])
    key, owners = key[new], owners[new]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    owners = owners[shared]
    named = np.empty(len(owners), dtype=REPLY)
    for field in ("set", "unit", "need"):
        named[field] = owners[field]
    named["count"] = 1
    replies = _summed(np.concatenate([replies, named]))
    return _pack_replies(replies, bits)


def _pack_replies(replies: np.ndarray, bits: int) -> pa.RecordBatch:
    bucket = mix(np.ascontiguousarray(replies["set"]).view(np.uint64)) >> np.uint64(64 - bits)
    return pack_replies(bucket.astype(np.int64), replies)


def _summed(replies: np.ndarray) -> np.ndarray:
    order = np.lexsort((replies["unit"], replies["set"]))
    replies = replies[order]
    start = np.ones(len(replies), dtype=bool)
    start[1:] = (replies["set"][1:] != replies["set"][:-1]) | (
        replies["unit"][1:] != replies["unit"][:-1]
    )
    first = np.flatnonzero(start)
    if not len(first):
        return replies
    out = replies[first].copy()
    out["count"] = np.add.reduceat(replies["count"], first)
    return out


def _enough(table: pa.Table) -> pa.RecordBatch:
    """The sets that share as much as they need."""
    _, _, replies = unpack(table, ENTRY, OWNER, REPLY)
    replies = _summed(replies)
    sets = np.unique(replies["set"][replies["count"] >= replies["need"]])
    return pa.RecordBatch.from_arrays([pa.array(sets)], names=["set"])


def _sharing(emitted: DataFrame, bits: int) -> DataFrame:
    """(set): those that may be linked with another."""

    def count(table: pa.Table) -> pa.RecordBatch:
        return _count_shared(table, bits)

    counted = reduce_buckets(emitted, count)
    return reduce_buckets(counted, _enough, "set bigint")


# --- the sets of documents -------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, first, second, text_sha256): size and identity of each row's set."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in utf8_rows(batch.column(1)):
                shingles = shingle_set(data)
                text = hashlib.sha256(data).hexdigest()
                rows.append((len(shingles), *identity(shingles), text))
            *columns, texts = list(zip(*rows)) if rows else [()] * 4
            numbers = [pa.array(c, type=pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(texts, type=pa.string())],
                names=["doc_id", "n_shingles", "first", "second", "text_sha256"],
            )

    return _texts(docs).mapInArrow(
        run,
        "doc_id bigint, n_shingles bigint, first bigint, second bigint, text_sha256 string",
    )


def _emit_documents(docs: DataFrame, bits: tuple[int, int]) -> DataFrame:
    def run(batches):
        def sets():
            for batch in batches:
                for data in utf8_rows(batch.column(1)):
                    shingles = shingle_set(data)
                    yield identity(shingles)[0], shingles

        yield from _emit(sets(), band_keys, *bits)

    return _texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, SCHEMA)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, shingles, doc_id): whole sets, as packed 64-bit hashes, of ``wanted(doc_id, set)``."""

    def run(batches):
        for batch in batches:
            rows = []
            ids, names = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for doc_id, name, data in zip(ids, names, utf8_rows(batch.column(0))):
                shingles = shingle_set(data)
                if identity(shingles)[0] == name:  # else another text of the same doc_id
                    rows.append((name, shingles.tobytes(), doc_id))
            columns = list(zip(*rows)) if rows else [()] * 3
            kinds = [pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                names=["set", "shingles", "doc_id"],
            )

    found = _texts(docs).join(wanted, "doc_id").withColumn("hash", F.xxhash64("text"))
    # repeated rows lie together already
    found = found.dropDuplicates(["doc_id", "hash"]).select("text", "doc_id", "set")
    return found.mapInArrow(run, "set bigint, shingles binary, doc_id bigint")


def _unpacked(batches) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield name, np.frombuffer(blob, dtype=np.uint64)


# --- candidates ------------------------------------------------------------------------------

MEMBER = np.dtype([("set", "<i8"), ("doc", "<i8"), ("label", "<i8"), ("n", "<u4")])
MEETINGS = 32  # keys by which a set gets its label
JOINED = 2  # times that labels give way to lesser ones
PAIRS = 2_000_000  # pairs a task holds before it yields them
CELL_BITS = 22  # counters of keys: 2 ** CELL_BITS of four bytes, whatever the corpus
SPANS = 64  # rows in which they travel


def _cells(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have the keys of each cell, in 2 ** CELL_BITS counters.

    Cells put keys in one order for all sets; which order it is, is a matter of speed.
    """
    size = (1 << CELL_BITS) // SPANS

    def count(batches):
        total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for _, shingles in _unpacked(batches):
            for _, _, keys in band_keys(shingles):
                np.add.at(total, _cells(keys), 1)
        spans = [k for k in range(SPANS) if total[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(spans, type=pa.int64()),
                pa.array([total[k * size : (k + 1) * size].tobytes() for k in spans], pa.binary()),
            ],
            names=["span", "counts"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.uint32)
        for blob in rows.column("counts").to_pylist():
            total += np.frombuffer(blob, dtype=np.uint32)
        return pa.table(
            {"span": rows.column("span")[:1], "counts": pa.array([total.tobytes()], pa.binary())}
        )

    kind = "span bigint, counts binary"
    spans = sets.select("set", "shingles").mapInArrow(count, kind)
    out = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    for row in spans.groupBy("span").applyInArrow(add, kind).collect():  # of fixed size
        part = np.frombuffer(bytes(row["counts"]), dtype=np.uint32)
        out[row["span"] * size : (row["span"] + 1) * size] = part
    return out


def meeting_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The parts of a set's sketches by which it meets candidates: the rarest of each band.

    Where linked sets agree in ``need`` of a set's N keys, at most N - need of these come before
    the first that they agree on, in an order that is the same for all sets.
    """
    chosen = []
    for _, need, keys in band_keys(shingles):
        order = np.lexsort((keys, counts[_cells(keys)]))
        chosen.append(keys[order[: len(keys) - need + 1]])
    return np.concatenate(chosen)


def _emit_rarest(sets: DataFrame, bits: int, counts, most: int | None = None) -> DataFrame:
    """Packed rows of the keys by which candidates meet, from ``(set, shingles, doc_id, label)``;
    at most ``most`` of each set, of least hash, if given."""

    def run(batches):
        owners, keys, held = [], [], 0

        def rows():
            key = np.concatenate(keys)
            owner = np.repeat(np.arange(len(owners)), [len(k) for k in keys])
            bucket, short = split_key(key, bits)
            entries = np.empty(len(key), dtype=ENTRY)
            entries["key"], entries["owner"] = short, owner
            return pack(bucket, entries, np.array(owners, dtype=MEMBER))

        for batch in batches:
            more = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for (doc_id, label), (name, shingles) in zip(more, _unpacked([batch])):
                own = meeting_keys(shingles, counts.value)
                if most:
                    own = own[np.argsort(mix(own))[:most]]
                owners.append((name, doc_id, label, len(shingles)))
                keys.append(own)
                held += len(own)
                if held >= FLUSH or len(owners) == MOST_OWNERS:
                    yield rows()
                    owners, keys, held = [], [], 0
        if owners:
            yield rows()

    return sets.select("set", "shingles", "doc_id", "label").mapInArrow(run, SCHEMA)


def _grouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members in order of key and doc_id, and starts and sizes of the keys' groups."""
    entries, owners, _ = unpack(table, ENTRY, MEMBER, REPLY)
    order = np.lexsort((owners["doc"], entries["key"]))
    key, owners = entries["key"][order], owners[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    return owners, start, np.diff(np.append(start, len(key)))


def _labels(table: pa.Table) -> pa.Table:
    """(set, label) of the sets that meet others in a bucket."""
    owners, start, sizes = _grouped(table)
    met = np.repeat(sizes > 1, sizes)
    label = np.repeat(owners["doc"][start], sizes)[met]
    names = owners["set"][met]
    order = np.lexsort((label, names))
    names, label = names[order], label[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = names[1:] != names[:-1]
    return pa.table({"set": pa.array(names[new]), "label": pa.array(label[new])})


def _across(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket's groups with different labels, if their sizes allow a link."""
    owners, start, sizes = _grouped(table)
    size = owners["n"].astype(np.int64)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"]
        )

    found: list[np.ndarray] = []
    held = 0
    for at, end in zip(start.tolist(), (start + sizes).tolist()):
        labels = owners["label"][at:end]
        if (labels == labels[0]).all():
            continue
        step = max(1, PAIRS // (end - at))
        for low in range(0, end - at, step):
            # a block of rows of the group's upper triangle
            i, j = np.nonzero(labels[low : low + step, None] != labels[None, low:])
            a, b = (x[j > i] + at + low for x in (i, j))
            fits = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
            found.append(np.stack([owners["set"][a[fits]], owners["set"][b[fits]]], axis=1))
            held += len(found[-1])
            if held >= PAIRS:
                yield batch(found)
                found, held = [], 0
    if found:
        yield batch(found)


def bit_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity bits: bit i is set if an odd number of shingles hash to it."""
    bit = (mix(shingles + np.uint64(1)) >> np.uint64(32)) * np.uint64(64 * words) >> np.uint64(32)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two whole sets are linked."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(both) - common)


def linked_pairs(
    sets: list[np.ndarray], first: np.ndarray, second: np.ndarray
) -> Iterator[tuple[int, int]]:
    """Linked ones of the pairs (first, second) of places in ``sets``, less those that others
    already connect.

    Sketches come before sets: sets whose sketches differ in more bits than linked sets in
    elements are not linked.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    fits = 4 * np.minimum(size[first], size[second]) >= 3 * np.maximum(size[first], size[second])
    first, second = first[fits], second[fits]
    words = 1 << min(12, max(4, int(size.max() // 8).bit_length()))
    sketch = np.stack([bit_sketch(s, words) for s in sets])
    step = max(1, 4_000_000 // words)
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for low in range(0, len(first), step):
        a, b = first[low : low + step], second[low : low + step]
        distance = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(7 * distance <= size[a] + size[b])
        near = near[np.argsort(distance[near], kind="stable")]  # what connects most comes first
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = find(i), find(j)
            if x != y and linked(sets[i], sets[j]):
                root[max(x, y)] = min(x, y)
                yield i, j


BLOCK = 1000  # sets of one label that are compared in one task; larger groups are cut


def _placed(labels: DataFrame) -> tuple[DataFrame, int]:
    """(set, label, cuts, cut): in how many blocks a label's sets are, and which one a set is in;
    and the number of blocks that hold all sets."""
    whole = max(1, -(-labels.count() // BLOCK))
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    placed = labels.join(sizes, "label").withColumn(
        "cut", F.pmod(F.xxhash64("set"), F.col("cuts"))
    )
    return materialize(placed, "blocks"), whole


def links_within(sets: DataFrame, placed: DataFrame, whole: int) -> DataFrame:
    """(a, b): links that connect all linked sets of one label.

    Small labels share tasks; of a large one, every two blocks meet in a task of their own.
    """
    low, high = F.least("cut", "other"), F.greatest("cut", "other")
    small = F.pmod(F.xxhash64("label"), F.lit(whole))
    rows = (
        placed.join(sets.select("set", "shingles"), "set")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn(
            "task", F.when(F.col("cuts") == 1, small).otherwise(F.xxhash64("label", low, high))
        )
    )

    def work(table: pa.Table) -> pa.Table:
        names, label, cut, other = (
            np.array(table.column(c).to_pylist(), dtype=np.int64)
            for c in ("set", "label", "cut", "other")
        )
        blobs = table.column("shingles").to_pylist()
        meeting = np.stack([label, np.minimum(cut, other), np.maximum(cut, other)], axis=1)
        found = []
        order = np.lexsort((names, *meeting.T[::-1]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (meeting[order[1:]] != meeting[order[:-1]]).any(axis=1)
        for at in np.split(order, np.flatnonzero(new)[1:]):
            if len(at) < 2:
                continue
            _, first, second = meeting[at[0]]
            if first == second:
                a, b = np.triu_indices(len(at), 1)
            else:  # blocks compare their own sets elsewhere
                a, b = (x.ravel() for x in np.meshgrid(
                    np.flatnonzero(cut[at] == first), np.flatnonzero(cut[at] == second)
                ))
            own = [np.frombuffer(blobs[k], dtype=np.uint64) for k in at]
            found += [(int(names[at[i]]), int(names[at[j]])) for i, j in linked_pairs(own, a, b)]
        return _edges(found)

    columns = rows.select("task", "set", "label", "cut", "other", "shingles")
    return columns.groupBy("task").applyInArrow(work, "a bigint, b bigint")


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    columns = list(zip(*found)) if found else [(), ()]
    return pa.table({n: pa.array(c, type=pa.int64()) for n, c in zip("ab", columns)})


def links_across(pairs: DataFrame, sets: DataFrame, placed: DataFrame, whole: int) -> DataFrame:
    """(a, b): links that connect all that the linked ones of ``pairs(a, b)`` connect.

    A pair goes to the task of its two blocks, where each set is needed once for all its pairs.
    """
    block = F.xxhash64("label", "cut")
    one = placed.select(F.col("set").alias("a"), block.alias("block_a"))
    two = placed.select(F.col("set").alias("b"), block.alias("block_b"))
    low, high = F.least("block_a", "block_b"), F.greatest("block_a", "block_b")
    tasked = (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", F.pmod(F.xxhash64(low, high), F.lit(4 * whole)).alias("task"))
    )
    tasked = materialize(tasked, "pairs")
    wanted = tasked.select(
        F.col("task").alias("at"), F.explode(F.array("a", "b")).alias("set")
    ).distinct()
    needed_sets = wanted.join(sets.select("set", "shingles"), "set")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = np.array(right.column("set").to_pylist(), dtype=np.int64)
        if not len(names) or not left.num_rows:
            return _edges([])
        order = np.argsort(names)
        blobs = right.column("shingles").to_pylist()
        own = [np.frombuffer(blobs[k], dtype=np.uint64) for k in order]
        names = names[order]
        a, b = (
            np.searchsorted(names, np.array(left.column(c).to_pylist(), dtype=np.int64))
            for c in ("a", "b")
        )
        return _edges([(int(names[i]), int(names[j])) for i, j in linked_pairs(own, a, b)])

    return (
        tasked.groupBy("task")
        .cogroup(needed_sets.groupBy("at"))
        .applyInArrow(work, "a bigint, b bigint")
    )


def _joined_labels(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(set, label): a label that is the doc_id of a set with a lesser one gives way to that, so
    that a large group whose sets don't all meet its least one has one label."""
    of_doc = (
        sets.select("set", "doc_id")
        .join(labels, "set")
        .where("label < doc_id")
        .groupBy(F.col("doc_id").alias("label"))
        .agg(F.min("label").alias("lesser"))
    )
    joined = labels.join(of_doc, "label", "left")
    return materialize(joined.select("set", F.coalesce("lesser", "label").alias("label")), "labels")


def candidate_links(sets: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that connect all linked sets of ``sets(set, shingles, doc_id)``."""
    spark = sets.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(sets))  # of fixed size
    alone = sets.withColumn("label", F.col("doc_id"))
    # which label a set has decides where it is compared, not whether
    labels = (
        _emit_rarest(alone, bits, counts, MEETINGS)
        .groupBy("bucket")
        .applyInArrow(_labels, "set bigint, label bigint")
        .unionByName(alone.select("set", "label"))
        .groupBy("set")
        .agg(F.min("label").alias("label"))
    )
    labels = materialize(labels, "labels")
    for _ in range(JOINED):
        labels = _joined_labels(sets, labels)
    placed, whole = _placed(labels)
    within = links_within(sets, placed, whole)
    named = sets.join(placed.select("set", "label"), "set")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _across(pa.Table.from_batches(list(batches)))

    pairs = (
        _emit_rarest(named, bits, counts)
        .groupBy("bucket")
        .applyInArrow(across, "a bigint, b bigint")
        .distinct()
    )
    return within.unionByName(links_across(pairs, sets, placed, whole))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, first, second) of all rows, and (set, root) of sets with links."""
    spark = docs.sparkSession
    described = materialize(document_sets(docs), "sets", keep=True)
    sized = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = sized.groupBy(F.col("first").alias("set")).agg(
        F.min("doc_id").alias("doc_id")
    )
    bits = _bits(spark, described.agg(F.sum("n_shingles")).first()[0])
    # stored before texts move, so that the keys' shuffle files are gone by then
    some = materialize(_sharing(_emit_documents(docs, bits), bits[1]), "near")
    wanted = classes.join(some, "set").select("doc_id", "set")
    sets = materialize(_sets_of(docs, wanted), "near-sets")
    size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0]
    bits = _bits(spark, (size or 0) // 8)

    def emit(batches):
        yield from _emit(_unpacked(batches), single_keys, *bits)

    rest = _sharing(sets.mapInArrow(emit, SCHEMA), bits[1])
    sets = materialize(sets.join(rest, "set"), "near-sets")
    return described, components(candidate_links(sets, bits[0]))


def _bits(spark: SparkSession, shingles: int | None) -> tuple[int, int]:
    """Bits of the number of buckets for keys, and for replies."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucket_bits(shingles or 0, partitions), reply_bits(shingles or 0)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row's whole text.

    ``component_id`` is the smallest doc_id reachable by links, itself included. Null texts and
    texts without words have no shingles and no links. Rows without an id are linked with
    nothing and have no component; repeated rows come back as they are, and different texts of
    one doc_id are compared each for itself. Other columns are ignored; an empty table gives an
    empty result. Sets are told apart by 64-bit sums of 64-bit hashes.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id")


def _judged(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with each row's text_sha256 and ``member_of``, a number of its component.

    Sets that are linked have one number; a text without shingles has none.
    """
    with scratch(docs.sparkSession):
        described, roots = links(docs)
        sized = described.where("doc_id IS NOT NULL AND n_shingles > 0")
        rooted = (
            sized.groupBy(F.col("first").alias("set"))
            .agg(F.min("doc_id").alias("least"))
            .join(roots.withColumnRenamed("node", "set"), "set", "left")
            .withColumn("root", F.coalesce("root", "set"))
        )
        least = rooted.groupBy("root").agg(F.min("least").alias("component"))
        members = rooted.join(least, "root").select(
            "set", "component", F.col("root").alias("member_of")
        )
        of_set = materialize(members, "components", keep=True)
    return described.join(
        of_set, (F.col("first") == F.col("set")) & (F.col("n_shingles") > 0), "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
            "component_id"
        ),
        "text_sha256",
        "member_of",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, less near duplicates.

    Of every component the text of its least doc_id stays. Of rows with one id and text one stays,
    that of the least hash of its other columns. Different texts of one id are told apart, so a text
    that is linked with nothing stays whatever its namesakes are; two near copies that both have
    their component's least id may both stay. Every row without an id stays.
    """
    own = ["_id", "_digest", "_row"]
    while set(own) & set(docs.columns):
        own = [f"{c}_" for c in own]
    key, mark, row = own
    alone = F.when(F.col("member_of").isNull(), F.col("text_sha256"))
    kept = (
        _judged(docs)
        .where("doc_id = component_id")
        .groupBy(F.col("doc_id").alias(key), "member_of", alone.alias("_alone"))
        .agg(F.min("text_sha256").alias(mark))
        .select(key, mark)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.where("doc_id IS NOT NULL").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
        F.col("doc_id").cast("bigint").alias(key),
        F.sha2(text, 256).alias(mark),
    )
    plain = [F.col(f"{row}.`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    named = (
        named.join(kept, [key, mark], "left_semi")
        .groupBy(key, mark)
        .agg(F.min_by(row, F.xxhash64(*plain)).alias(row))
        .select(f"{row}.*")
    )
    return named.unionByName(docs.where("doc_id IS NULL"))
