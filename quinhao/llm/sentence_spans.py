"""Repeated passages, found as sliding spans of consecutive clauses, parts of sentences.

From every clause on, the shortest run of at least two of them and MIN_WORDS words is one span. Spans are hashed and joined over all documents; the first occurrence, that of the lowest
doc_id and then of the lowest place, stays, and the sentences of all others are removed.
Sentences are first cut into clauses where their words say so, so that a passage has the same spans
whatever stands before and after it in its first and last sentence, and text without full stops has
spans too. In scripts without blanks every letter is a word, and two count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quinhao.llm.common import materialize

MIN_WORDS = 20
MAX_WORDS = 24  # clauses are no longer
CLAUSE = 6  # words of a clause, on average
MEMO = 1 << 16  # words whose marks a task keeps
SLICE = 1 << 20  # bytes of text that a task holds as Python strings at a time

# A sentence runs through its closing marks and the blanks after them; all pieces together are
# the text.
STOPS = ".!?\n\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0964"
SENTENCES = re.compile(rf"[^{STOPS}]+[{STOPS}]*\s*|[{STOPS}]+\s*").findall
# Thai to Lao, Burmese, Khmer, kana, ideographs
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff"
)
LETTERS = re.compile(f"[{UNSPACED}]")
WORDS = re.compile(r"\s*\S+\s*").findall
MIXED_WORDS = re.compile(rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)\s*").findall


@lru_cache(MEMO)
def ends_clause(word: str) -> bool:
    return xxhash.xxh3_64_intdigest(word.strip().lower().encode()) % CLAUSE == 0


def split_sentences(text: str) -> list[str]:
    out = []
    words_of = WORDS if text.isascii() or not LETTERS.search(text) else MIXED_WORDS
    for sentence in SENTENCES(text):
        clause: list[str] = []
        for word in words_of(sentence):
            clause.append(word)
            if ends_clause(word) or len(clause) == MAX_WORDS:
                out.append("".join(clause))
                clause = []
        if clause:
            out.append("".join(clause))
        elif not sentence.strip():
            out.append(sentence)  # blanks only
    return out


def n_words(words: list[str]) -> int:
    """Words between blanks, but two letters of a script without blanks as one."""
    whole = " ".join(words)
    if whole.isascii() or not (letters := len(LETTERS.findall(whole))):
        return len(words)
    return len(LETTERS.sub(" ", whole).split()) + (letters + 1) // 2


def spans(sentences: list[str], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, end) of every span; blanks and letter case don't matter."""
    words = [s.lower().split() for s in sentences]
    full = [k for k, w in enumerate(words) if w]  # blank pieces are no sentences
    sizes = [n_words(words[k]) for k in full]
    digests = [xxhash.xxh3_128_digest(" ".join(words[k]).encode()) for k in full]
    found = []
    end = total = 0
    for start in range(len(full)):
        while end < len(full) and (total < min_words or end < start + 2):
            total += sizes[end]
            end += 1
        if total < min_words or end < start + 2:
            break
        value = xxhash.xxh3_64_intdigest(b"".join(digests[start:end]))
        found.append((value - (1 << 63), full[start], full[end - 1] + 1))
        total -= sizes[start]
    return found


def slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts, each with ``most`` bytes of text in column ``at`` or a single row.

    A batch has as many rows as the session says, however long they are.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _spans_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(span, doc_id, again): the distinct spans of each row, and those it has more than once."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            ids, values, marks = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = np.array(
                    [h for h, _, _ in spans(split_sentences(text), min_words)], dtype=np.int64
                )
                own = np.unique(every)
                repeats = len(own) < len(every)
                ids.append(np.full(len(own) + repeats, doc_id, dtype=np.int64))
                values += [own, own[:1]] if repeats else [own]
                marks += [np.zeros(len(own), bool), np.ones(int(repeats), bool)]
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (values, ids, marks)],
                    names=["span", "doc_id", "again"],
                )

    return docs.mapInArrow(run, "span bigint, doc_id bigint, again boolean")


def later_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, spans): the spans of each document that a document of lower id has too.

    Documents with a span of their own twice are there as well, with no spans if they share none.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    stored = materialize(_spans_of(texts, min_words), "spans")
    found = stored.where("NOT again").drop("again")
    # tasks keep one sum a span, so a frequent span is a few rows when it moves
    repeated = (
        found.groupBy("span")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("last > first")
    )
    # the engine splits this join's large partitions, so a span that many documents share is
    # joined in several tasks
    later = (
        found.join(repeated.hint("shuffle_merge"), "span")
        .where("doc_id > first")
        .select("doc_id", "span")
    )
    alone = stored.where("again").select("doc_id", F.lit(None).cast("bigint").alias("span"))
    # a null is not collected
    return later.union(alone).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False
) -> DataFrame:
    """All rows of ``docs`` and its columns, with repeated passages removed from ``text``.

    ``n_chars``, if there is one, becomes the new length; ``counts`` adds ``n_sentences`` and
    ``n_removed``. Rows of one doc_id count as one document. Null texts stay null, rows without
    an id and texts too short for a span stay as they are; a text with nothing left is empty.
    """
    key, mark = "_doc", "_later"
    while {key, mark} & set(docs.columns):
        key, mark = key + "_", mark + "_"
    later = later_spans(docs, min_words).select(
        F.col("doc_id").alias(key), F.col("spans").alias(mark)
    )
    joined = docs.join(later, docs["doc_id"].cast("bigint") == F.col(key), "left").drop(key)
    at = docs.columns.index("text")
    key_at = docs.columns.index("doc_id")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    fields = list(docs.schema.fields)
    fields[at] = T.StructField("text", T.StringType())
    if chars is not None:
        fields[chars] = T.StructField("n_chars", T.LongType())
    if counts:
        fields += [T.StructField(c, T.LongType()) for c in ("n_sentences", "n_removed")]
    schema = T.StructType(fields)

    def clean(text, known, named):
        if text is None:
            return None, 0, 0
        if known is None and named:  # nothing of it is there twice
            return text, len(split_sentences(text)) if counts else 0, 0
        sentences = split_sentences(text)
        keep = [True] * len(sentences)
        seen = set(known or ())
        for value, start, end in spans(sentences, min_words):
            if value in seen:
                keep[start:end] = [False] * (end - start)
            seen.add(value)
        removed = len(keep) - sum(keep)
        if removed:
            text = "".join(s for s, k in zip(sentences, keep) if k)
        return text, len(keep), removed

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, at, SLICE)):
            known = batch.column(batch.num_columns - 1).to_pylist()
            named = pc.is_valid(batch.column(key_at)).to_pylist()
            rows = [clean(*r) for r in zip(batch.column(at).to_pylist(), known, named)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([r[0] for r in rows], type=pa.string())
            if chars is not None:
                sizes = [None if r[0] is None else len(r[0]) for r in rows]
                columns[chars] = pa.array(sizes, type=pa.int64())
            if counts:
                columns += [pa.array([r[i] for r in rows], type=pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
