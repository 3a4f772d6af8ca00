"""Quality rules whose cutoffs come from labelled documents with a bound on false rejections.

Each rule rejects documents above a cutoff of some share of their text. For every stratum (the
documents of one ``lang``) the good ones among the labels show how many each cutoff would reject
wrongly. A cutoff is admissible if the exact binomial (Clopper-Pearson) upper bound of that rate
stays below the rule's part of the allowed rate, at a confidence corrected for all strata, rules
and cutoffs that are tested (Bonferroni). The lowest admissible cutoff is used; where the labels
are too few to prove any, the rule stays off. So with probability ``1 - delta`` no stratum loses
more than ``alpha`` of its good documents to the rules.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quinhao.llm.common import materialize, scratch

ALPHA, DELTA = 0.02, 0.05
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Cutoffs, rising, in thousandths of the share named in RULES.
SHARES = (5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900)
LENGTHS = tuple(range(5000, 15001, 500))  # thousandths of characters a word
CUTOFFS = {"symbols": SHARES, "dup_lines": SHARES, "repeats": SHARES, "word_length": LENGTHS}


def rule_values() -> dict[str, Column]:
    """What each rule compares with its cutoff; every one rejects values above it."""

    def share(part: str, whole: str) -> Column:
        return 1000.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, first ones included."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.asarray([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    size = len(index)
    code = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:  # else the product below stays within 63 bits
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    code = code * size + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(words), dtype=bool)
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        hit[twice + shift] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of FEATURES of one whole text; all zero for null and for no words."""
    text = text or ""
    words = text.encode().split()  # of bytes, so at these six blanks only
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        lines,
        dup,
        repeated_words(words),
    )


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of FEATURES, row by row."""
    kind = T.StructType([T.StructField(f, T.LongType()) for f in FEATURES])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            # text by text: a list of them would be a batch's texts once more
            rows = [measure(t.as_py()) for t in batch.column(at)]
            columns = list(zip(*rows)) if rows else [()] * len(FEATURES)
            struct = pa.StructArray.from_arrays(
                [pa.array(c, type=pa.int64()) for c in columns], names=list(FEATURES)
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=schema.names)

    return docs.mapInArrow(run, schema)


def too_many(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the upper Clopper-Pearson bound at ``delta`` of k out of n exceeds ``alpha``.

    The bound is at most ``alpha`` just when k or fewer hits have at most probability ``delta``
    at rate ``alpha``.
    """
    if k >= n * alpha:
        return True
    log = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    )
    term, total = 1.0, 0.0
    for j in range(k, -1, -1):
        total += term
        term *= j / (n - j + 1) * (1 - alpha) / alpha
        if term < total * 1e-17:
            break
    return log + math.log(total) > math.log(delta)


def select_cutoffs(
    features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """(stratum, rule, cutoff): the lowest admissible cutoff of each, null where none is.

    ``features`` has doc_id, stratum and the columns of FEATURES. A document with several labels
    counts once, as good if any of them says so; labels without a document count nowhere.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    values = rule_values()
    # how many cutoffs of a rule reject the document: all below its value
    beaten = [
        F.struct(
            F.lit(rule).alias("rule"),
            reduce(
                lambda a, b: a + b, [(value > c).cast("int") for c in CUTOFFS[rule]]
            ).alias("beaten"),
        )
        for rule, value in values.items()
    ]
    found = (
        features.where("n_words >= 50")
        .join(good.select("doc_id"), "doc_id", "left_semi")
        .select("stratum", F.inline(F.array(*beaten)))
        .groupBy("stratum", "rule", "beaten")
        .count()
    )
    found = materialize(found, "quality-counts")  # a row per stratum, rule and cutoff at most
    strata = max(1, found.select("stratum").distinct().count())
    tests = strata * sum(map(len, CUTOFFS.values()))
    part = alpha / len(CUTOFFS)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cutoffs = CUTOFFS[key[1]]
        counts = np.zeros(len(cutoffs) + 1, dtype=np.int64)
        np.add.at(counts, rows["beaten"].to_numpy(), rows["count"].to_numpy())
        n = int(counts.sum())
        rejected = n - np.cumsum(counts)  # by cutoff number 0, 1, ...
        for cutoff, k in zip(cutoffs, rejected):
            if not too_many(int(k), n, part, delta / tests):
                return pd.DataFrame([(*key, float(cutoff))])
        return pd.DataFrame([(*key, None)])

    return found.groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cutoff double"
    )


def _stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("stratum")


FEW_STRATA = 100_000  # so many rows of a few numbers are broadcast


def _limits(cutoffs: DataFrame) -> DataFrame:
    """One row per stratum, a column per rule; to be broadcast if its rows are few."""
    wide = cutoffs.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_max_{r}") for r in CUTOFFS]
    )
    wide = materialize(wide, "quality-cutoffs", keep=True)
    return F.broadcast(wide) if wide.count() <= FEW_STRATA else wide


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _passes() -> Column:
    checks = [
        F.coalesce(value <= F.col(f"_max_{rule}"), F.lit(True))
        for rule, value in rule_values().items()
    ]
    return ~_base_failed() & reduce(lambda a, b: a & b, checks)


def features_of(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, FEATURES) of every row."""
    return with_features(docs.select("doc_id", "text", "lang"), "_f").select(
        F.col("doc_id").cast("bigint"), _stratum(), "_f.*"
    )


def quality(
    docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """(doc_id, FEATURES, base_failed, kept) of every row's whole text.

    Null and wordless texts have zeros and fail the base rules; a null ``lang`` is a stratum of
    its own; repeated rows and null ids come back as they are; without labels, or without rows,
    only the base rules decide.
    """
    with scratch(docs.sparkSession):
        features = materialize(features_of(docs), "quality", keep=True)
        limits = _limits(select_cutoffs(features, labels, alpha, delta))
    return features.join(limits, "stratum", "left").select(
        "doc_id", *FEATURES, _base_failed().alias("base_failed"), _passes().alias("kept")
    )


def kept_documents(
    docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; features are taken where texts lie."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    with scratch(docs.sparkSession):
        limits = _limits(select_cutoffs(features_of(docs), labels, alpha, delta))
    limits = limits.withColumnRenamed("stratum", f"{name}stratum")
    measured = with_features(docs, name)
    judged = measured.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{name}doc"),
        F.col(name).alias("_f"),
        _stratum("lang").alias(f"{name}key"),
    ).select(f"{name}doc", "_f.*", f"{name}key")
    return (
        judged.join(limits, F.col(f"{name}key") == F.col(f"{name}stratum"), "left")
        .where(_passes())
        .select(f"{name}doc.*")
    )
