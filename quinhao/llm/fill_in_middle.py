"""Fill-in-the-middle texts, cut at code points and built from bytes.

A text stays UTF-8. ``SparseIndex`` records only its multibyte characters: where each one starts and
how many bytes beyond one they have had so far. A cut given in code points becomes one in bytes (or
the other way) by one binary search among these; between them, and in a text of ASCII, places in
code points and in bytes differ by a constant.

Defined for every row: a null text is empty; an empty text, or one that holds a marker, stays plain;
a null id takes part in the hash as an empty string; repeated rows give equal results; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quinhao.llm.common import utf8_rows

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BATCH_BYTES = 32 << 20  # of texts that leave a task at once
CUT_SCHEMA = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
)
NAMES = [column.split()[0] for column in CUT_SCHEMA.split(", ")]


class SparseIndex:
    """Places in code points and in bytes of one UTF-8 text."""

    def __init__(self, data: np.ndarray):
        """``data`` are the bytes, as unsigned 8-bit numbers."""
        self.at_byte = np.flatnonzero(data >= 0xC0)  # lead bytes; those that follow are below
        lead = data[self.at_byte]
        over = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(over)])
        self.at_point = self.at_byte - self.excess[:-1]
        self.n_points = len(data) - int(self.excess[-1])

    def to_byte(self, point: int) -> int:
        """Byte at which code point number ``point`` starts."""
        return point + int(self.excess[np.searchsorted(self.at_point, point)])

    def to_point(self, byte: int) -> int:
        """Number of the code point that starts at ``byte``."""
        return byte - int(self.excess[np.searchsorted(self.at_byte, byte)])


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    """The four 32-bit numbers that decide a document's form and cuts."""
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int(x) for x in np.frombuffer(digest, dtype=">u4", count=4))


def transform(
    data: np.ndarray, doc_id: int | None, seed: str, plain_percent: int, spm_percent: int
) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    index = SparseIndex(data)
    n, text = index.n_points, data.tobytes()
    h1, h2, h3, h4 = draws(doc_id, seed)
    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or h3 % 100 >= 100 - plain_percent:
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.to_byte(first), index.to_byte(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        form, parts = SPM, (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = PSM, (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, first, last - first, b"".join(parts)


def rebuild(output: bytes, form: str) -> tuple[int | None, int | None, bytes]:
    """(prefix_chars, middle_chars, text) from an output and its form alone.

    The parts hold no marker and none can arise where a part meets one, so the first mark found is
    the one that was set.
    """
    if form == PLAIN:
        return None, None, output
    second = SUFFIX if form == PSM else PREFIX
    one = output.index(second, len(PREFIX))
    two = output.index(MIDDLE, one + len(second))
    front, back = output[len(PREFIX) : one], output[one + len(second) : two]
    middle = output[two + len(MIDDLE) :]
    prefix, suffix = (front, back) if form == PSM else (back, front)
    text = b"".join((prefix, middle, suffix))
    index = SparseIndex(np.frombuffer(text, dtype=np.uint8))
    first = index.to_point(len(prefix))
    return first, index.to_point(len(prefix) + len(middle)) - first, text


def fill_in_middle(
    docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text as training takes it.

    So many percent of the documents stay plain, and of the rest so many have the suffix first.
    What becomes of a document depends on its id and ``seed`` only, so a lost task repeats it alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            ids, points, forms, *cuts = zip(*held, strict=True)
            front = [pa.array(ids, pa.int64()), pa.array(points, pa.int64()), pa.array(forms)]
            own = _columns(list(zip(*cuts, strict=True)))
            return pa.RecordBatch.from_arrays([*front, *own], names=NAMES)

        for batch in batches:
            held, size = [], 0
            ids = batch.column(0).to_pylist()
            for doc_id, data in zip(ids, utf8_rows(batch.column(1)), strict=True):
                row = transform(data, doc_id, seed, plain_percent, spm_percent)
                held.append((doc_id, *row))
                size += len(row[-1])
                if size >= BATCH_BYTES:
                    yield pack()
                    held, size = [], 0
            if held:
                yield pack()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, CUT_SCHEMA)


def restored(cut: DataFrame) -> DataFrame:
    """``cut`` with ``text`` and its cuts as found in the output, in place of the output.

    Works from the columns ``form`` and ``output`` alone; any others are kept.
    """
    kept = [f for f in cut.schema.fields if f.name != "output"]
    added = "found_prefix_chars bigint, found_middle_chars bigint, text string"
    schema = T.StructType([*kept, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            start, size, held = 0, 0, []
            for k, data in enumerate(utf8_rows(batch.column("output"))):
                held.append(rebuild(data.tobytes(), forms[k]))
                size += len(held[-1][-1])
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(held))
                    own = [part.column(f.name) for f in kept]
                    yield pa.RecordBatch.from_arrays([*own, *_columns(held)], names=schema.names)
                    start, size, held = k + 1, 0, []

    return cut.mapInArrow(run, schema)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    """(prefix_chars, middle_chars, text) of many rows."""
    prefixes, middles, texts = zip(*rows, strict=True)
    return [
        pa.array(prefixes, pa.int64()),
        pa.array(middles, pa.int64()),
        pa.array(texts, pa.binary()).cast(pa.string()),
    ]


def digests(docs: DataFrame) -> DataFrame:
    """Forms and cuts of every document, with digests of its output and of the text rebuilt from it."""
    cut = fill_in_middle(docs).withColumn("output_sha256", F.sha2("output", 256))
    return restored(cut).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        F.sha2("text", 256).alias("restored_sha256"),
    )
