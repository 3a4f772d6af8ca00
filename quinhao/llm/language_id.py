"""Language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams of one to four bytes, hashed into a fixed number of bits
(presence, not counts). The kernel of two texts is the normalised size of their common bits. A
bounded sample of labelled texts gives Nystroem landmarks; kernel ridge regression, one target
per language, is solved in the landmarks' space. As the kernel is a dot product of bits, the
solution folds into one weight per bit and language, and texts are scored by batched matrix
products.

A long text would set nearly all bits. It is cut into sections of equal size, and its score is the
mean of theirs, so that a text of any length is judged, whole, on sets as large as a page's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quinhao.llm.common import utf8_rows

BITS = 8192
SAMPLE = 4096  # labelled texts learnt from, shared evenly by the languages
LEAST = 8  # but so many of each language, however many there are
FEW_LANGUAGES = 10_000  # so many row counts are broadcast
LANDMARKS = 384
RIDGE = 1e-3
BLOCK = 512  # sections scored at once
SECTION = 1 << 13  # bytes of a section at most


def sections(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in the fewest sections of at most SECTION bytes, as even as can be; each
    goes three bytes into the next one, so that no n-gram is lost."""
    count = max(1, -(-len(data) // SECTION))
    for k in range(count):
        yield data[k * len(data) // count : (k + 1) * len(data) // count + 3]


def presence(data: np.ndarray, out: np.ndarray) -> None:
    """Set in ``out`` (BITS long) the bits of the n-grams of a section."""
    lower = (data >= 65) & (data <= 90)
    b = (data + (lower * np.uint8(32))).astype(np.uint32)
    code = b
    for n in range(1, 5):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        if not len(code):
            break
        h = (code + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[(h * np.uint32(0x85EBCA6B)) >> np.uint32(19)] = 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BITS x languages
    offset: np.ndarray

    def score(self, bits: np.ndarray) -> np.ndarray:
        """Scores of texts x languages, from texts x BITS of presence."""
        x = bits.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.weights) / norm + self.offset


    def mean_scores(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """Scores of whole texts: means over their sections, a block of sections at a time."""
        sums, counts = [], []
        bits, owners = np.zeros((BLOCK, BITS), dtype=np.uint8), []

        def add():
            for k, row in zip(owners, self.score(bits[: len(owners)])):
                sums[k] += row
            bits[: len(owners)] = 0
            owners.clear()

        for data in texts:
            sums.append(np.zeros(len(self.languages)))
            counts.append(0)
            for part in sections(data):
                presence(part, bits[len(owners)])
                owners.append(len(sums) - 1)
                counts[-1] += 1
                if len(owners) == BLOCK:
                    add()
        add()
        return np.reshape(sums, (len(sums), -1)) / np.reshape(counts, (-1, 1))


def fit(packed: np.ndarray, languages: list[str]) -> Model:
    """Kernel ridge regression on landmarks spread evenly over the sample.

    ``packed`` has BITS / 8 bytes a text and is unpacked a block at a time. Of the targets, one per
    language, only their sums with the texts' kernels are kept, so the number of languages costs a
    column of weights each, and no matrix of texts by languages.
    """
    names, target = np.unique(np.asarray(languages, dtype=object), return_inverse=True)

    def rows(chosen) -> np.ndarray:
        x = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    size = len(packed)
    offset = np.bincount(target, minlength=len(names)) / size
    marks = rows(np.unique(np.linspace(0, size - 1, min(LANDMARKS, size)).astype(int)))
    inner = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    use = values > max(values[-1], 1e-12) * 1e-8
    root = vectors[:, use] / np.sqrt(values[use])  # inner ** -1/2
    square = np.zeros((root.shape[1], root.shape[1]))
    by_name = np.zeros((len(names), root.shape[1]))
    for start in range(0, size, BLOCK):
        z = (rows(slice(start, start + BLOCK)) @ marks.T).astype(np.float64) @ root
        square += z.T @ z
        np.add.at(by_name, target[start : start + BLOCK], z)
    aim = by_name.T - np.outer(by_name.sum(axis=0), offset)  # z.T @ (targets - their means)
    solved = np.linalg.solve(square + RIDGE * size * np.eye(len(square)), aim)
    weights = marks.T @ (root @ solved).astype(np.float32)
    return Model(names.tolist(), weights, offset.astype(np.float32))


def _bits(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, bits) with the presence bits packed, BITS / 8 bytes a row: of the whole
    text, or of one section of a long one, which its checksum says."""

    def run(batches):
        for batch in batches:
            packed = []
            for data in utf8_rows(batch.column(2)):
                bits = np.zeros(BITS, dtype=np.uint8)
                parts = list(sections(data))
                presence(parts[zlib.crc32(data) % len(parts)], bits)
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())],
                names=["doc_id", "lang", "bits"],
            )

    return docs.select("doc_id", "lang", "text").mapInArrow(
        run, "doc_id bigint, lang string, bits binary"
    )


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` rows of ``docs`` (LEAST a language), those of least hash.

    Only the sample's packed bits reach the driver, BITS / 8 bytes a row: 8 KB a language once there
    are so many that LEAST holds, where the model has 32 KB for each. None without rows.
    """
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_rows"))
    languages = counts.count()
    if not languages:
        return None
    quota = max(LEAST, sample // languages)
    # by hash, about twice the quota of each language, however many rows it has
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("_rows")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        named.select("lang", "doc_id")
        .join(F.broadcast(counts) if languages <= FEW_LANGUAGES else counts, "lang")
        .where(share < (2 * quota + 64) * (1 << 30))
        .dropDuplicates(["lang", "doc_id"])
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= quota)
        .select("doc_id")
        .distinct()
    )  # at most quota rows a language
    picked = named.join(F.broadcast(chosen), "doc_id", "left_semi")
    one_each = _bits(picked).groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("row"))
    rows = one_each.select("doc_id", "row.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in rows), dtype=np.uint8)
    return fit(packed.reshape(len(rows), -1), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; only the text decides.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    was learnt. Equal scores go to the first language in order. Repeated rows and null ids come
    back as they are; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            named = [
                any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()
            ]
            if model and len(named):
                s = model.mean_scores(utf8_rows(texts))
                best, scores = s.argmax(axis=1).tolist(), np.clip(s.max(axis=1), 0.0, 1.0).tolist()
            else:
                named, best, scores = [False] * len(named), [0] * len(named), [0.0] * len(named)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(
                        [model.languages[i] if n else "und" for i, n in zip(best, named)],
                        type=pa.string(),
                    ),
                    pa.array([s if n else 0.0 for s, n in zip(scores, named)], type=pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    ).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out():
    """Every document whose id's checksum leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the other three quarters."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
