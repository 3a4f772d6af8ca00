"""Moving many small entries between tasks as a few rows of packed arrays.

An entry belongs to an owner (a document, say) and to a bucket. A task packs the entries of many
documents into one row per bucket: its owners once, and a fixed-width record per entry. Rows of
a bucket meet in one task; buckets are so many that each holds a bounded number of entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket bigint, owners binary, entries binary, replies binary"
NAMES = ["bucket", "owners", "entries", "replies"]
KINDS = pa.schema(
    [("bucket", pa.int64()), ("owners", pa.binary()), ("entries", pa.binary()),
     ("replies", pa.binary())]
)
PER_BUCKET = 1_000_000  # entries a bucket holds on average
MOST_OWNERS = 65_535  # in one row, as an entry counts its owners in 16 bits


def bucket_bits(entries: int, partitions: int) -> int:
    """Bits of the number of buckets, for so many entries and about two for each task at least.

    No more than that: the more buckets, the more rows name the same owner.
    """
    return max(1, int(max(entries / PER_BUCKET, 1.5 * partitions) - 1).bit_length())


def reply_bits(entries: int) -> int:
    """Bits of the number of buckets for replies to the owners of so many entries.

    Replies are fewer and go from every bucket of entries to every one of these, so these are
    no more than their own number asks for.
    """
    return max(5, int(max(1, entries / (8 * PER_BUCKET)) - 1).bit_length())


def split_key(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 32 bits that tell keys of a bucket apart, of a scattered 64-bit key."""
    return (
        (key >> np.uint64(64 - bits)).astype(np.int64),
        ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32),
    )


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def pack(bucket: np.ndarray, entries: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; ``entries['owner']`` counts in ``owners``, of which a row has its own."""
    rows = []
    for number, at in _slices(bucket):
        part = entries[at]
        used, part["owner"] = np.unique(part["owner"], return_inverse=True)
        rows.append((number, owners[used].tobytes(), part.tobytes(), None))
    return _batch(rows)


def pack_replies(bucket: np.ndarray, replies: np.ndarray) -> pa.RecordBatch:
    return _batch([(n, None, None, replies[at].tobytes()) for n, at in _slices(bucket)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, KINDS)], schema=KINDS
    )


def _joined(blobs: list, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(b for b in blobs if b), dtype=kind)


def unpack(
    table: pa.Table, entry: np.dtype, owner: np.dtype, reply: np.dtype
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries, the owner of each, and all replies among a bucket's rows."""
    blobs = table.column("entries").to_pylist()
    parts = [np.frombuffer(b, dtype=entry) for b in blobs if b]
    names = [np.frombuffer(b, dtype=owner) for b in table.column("owners").to_pylist() if b]
    entries = np.concatenate([*parts, np.zeros(0, entry)])
    owners = np.concatenate([*[o[e["owner"]] for o, e in zip(names, parts)], np.zeros(0, owner)])
    return entries, owners, _joined(table.column("replies").to_pylist(), reply)


def reduce_buckets(
    rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str = SCHEMA
) -> DataFrame:
    """Apply ``work`` to all rows of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([work(table)])

    return rows.groupBy("bucket").applyInArrow(run, schema)
