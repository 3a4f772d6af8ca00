"""URL filter: fixed rules first, then the likelihood ratio of two character language models.

One smoothed variable-order Markov model is counted on the URLs that rules accept, another on
those they reject. A context that was rarely seen leans on the next shorter one. The difference
of the two log-likelihoods, divided by the URL's length, is compared with a threshold calibrated
on labelled URLs that were not counted.

The models are exact counts in a distributed table, one row for each different string of a byte and
the five before it; they grow with the labelled URLs, and no task or driver holds a model. What a
byte adds to a URL's score depends on that string alone, so each different one is scored once, by
joins with the counts of its six endings, and URLs meet the scores of their strings in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, scratch, utf8_rows

ORDERS = 6  # contexts of 0 to 5 bytes
SHORT = 2  # orders so low that all their strings, 256 and 65,536 at most, can be broadcast
LEAN = 2.0  # weight of the shorter context, in counts
FOLDS = 5  # one in so many labelled URLs calibrates instead of being counted
STEP = 0.01  # grid of thresholds
BOUND = 10.0
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 19  # URLs that meet their strings' scores together


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, upper.lower())
    return (
        F.coalesce(host, F.lit("")),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")),
    )


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) struct of the longest rule that fits, null if none does.

    A rule is a host, which stands for its subdomains too, and the path's beginning. Of equally
    long ones the first in order of text wins.
    """
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def grams(rows: list[np.ndarray]) -> np.ndarray:
    """For all bytes of the URLs, each with the five bytes before it: 48 bits, the byte lowest.

    Each URL is read after ORDERS - 1 zero bytes, so contexts never reach into its neighbour.
    """
    pad = np.zeros(ORDERS - 1, dtype=np.uint8)
    data = np.concatenate([pad, *[x for row in rows for x in (row, pad)]]).astype(np.int64)
    gram = np.zeros(len(data), dtype=np.int64)
    for back in range(ORDERS):
        gram[back:] |= data[: len(data) - back] << (8 * back)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    starts = np.cumsum(sizes + len(pad)) - sizes
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return gram[shift + np.arange(sizes.sum())]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n_0, n_1): uses of each string in rejected and accepted ``(url, accepted)`` rows."""

    def run(batches):
        for batch in batches:
            accepted = np.array(batch.column(1).to_pylist(), dtype=bool)
            rows = list(utf8_rows(batch.column(0)))
            mine = np.repeat(accepted, [len(r) for r in rows])
            gram, place = np.unique(grams(rows), return_inverse=True)
            sums = [np.bincount(place[mine == cls], minlength=len(gram)) for cls in (False, True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=pa.int64()) for x in (gram, *sums)], names=["gram", "n_0", "n_1"]
            )

    return (
        labelled.select("url", "accepted")
        .mapInArrow(run, "gram bigint, n_0 bigint, n_1 bigint")
        .groupBy("gram")
        .agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))
    )


def _endings(gram: str) -> Column:
    """(order, ending, context): the last bytes of a string, by the length of the context."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(order).alias("order"),
                    F.col(gram).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("ending"),
                    F.shiftright(
                        F.col(gram).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)), 8
                    ).alias("context"),
                )
                for order in range(ORDERS)
            ]
        )
    )


def gram_ratios(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio) of each different ``gram`` of ``wanted``: accepted over rejected, as a log."""
    sums = [F.sum(c).alias(c) for c in ("n_0", "n_1")]
    hits = (
        counts.select(_endings("gram").alias("e"), "n_0", "n_1")
        .groupBy("e.order", "e.ending", "e.context")
        .agg(*sums)
    )
    hits = materialize(hits, "endings")
    seen = hits.groupBy("order", "context").agg(
        F.sum("n_0").alias("s_0"), F.sum("n_1").alias("s_1")
    )
    hits = hits.drop("context")
    needs = wanted.select("gram").distinct().select("gram", _endings("gram").alias("e"))
    needs = needs.select("gram", "e.*")
    low, high = F.col("order") < SHORT, F.col("order") >= SHORT
    known = (
        needs.where(low)
        .join(F.broadcast(hits.where(low)), ["order", "ending"], "left")
        .join(F.broadcast(seen.where(low)), ["order", "context"], "left")
    ).unionByName(
        needs.where(high)
        .join(hits.where(high), ["order", "ending"], "left")
        .join(seen.where(high), ["order", "context"], "left")
    )
    own = [
        F.coalesce(F.sum(F.when(F.col("order") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
        for k in range(ORDERS)
        for c in ("n_0", "n_1", "s_0", "s_1")
    ]
    logs = []
    for cls in (0, 1):
        p = F.lit(1 / 256)
        for k in range(ORDERS):
            p = (F.col(f"n_{cls}_{k}") + LEAN * p) / (F.col(f"s_{cls}_{k}") + LEAN)
        logs.append(F.ln(p))
    return known.groupBy("gram").agg(*own).select("gram", (logs[1] - logs[0]).alias("ratio"))


def _blocks(pages: DataFrame) -> DataFrame:
    """(block, rows, grams): some rows together, ``url`` last, and the strings of their URLs."""
    names = pages.columns

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            sizes = [len(r) for r in utf8_rows(batch.column(len(names) - 1))]
            start = held = 0
            for k, size in enumerate(sizes):
                held += size
                end = k + 1
                if held >= BLOCK_BYTES or end - start == BLOCK_ROWS or end == len(sizes):
                    part = batch.slice(start, end - start)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    own = np.unique(grams(list(utf8_rows(part.column(len(names) - 1)))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([next(number)], pa.int64()),
                            pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                            pa.array([own], pa.list_(pa.int64())),
                        ],
                        names=["block", "rows", "grams"],
                    )
                    start, held = end, 0

    return pages.mapInArrow(run, "block bigint, rows binary, grams array<bigint>")


def with_scores(pages: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row's ``url``: mean ratio of its bytes.

    A frequent string is a row for each block of URLs, however many of them have it.
    """
    kept = pages.select(*keep, "url")
    schema = kept.drop("url").schema.add("score", "double")
    blocks = materialize(_blocks(kept), "url-blocks")
    wanted = blocks.select("block", F.explode("grams").alias("gram"))
    scores = (
        wanted.join(gram_ratios(wanted, counts), "gram")
        .groupBy("block")
        .agg(F.collect_list(F.struct("gram", "ratio")).alias("scores"))
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = pa.ipc.open_stream(batch.column(0)[k].as_buffer()).read_all()
                rows = rows.combine_chunks().to_batches()[0]
                found = batch.column(1)[k].values
                out = np.zeros(rows.num_rows)
                if found is not None and len(found):
                    known = found.field("gram").to_numpy(zero_copy_only=False)
                    ratio = found.field("ratio").to_numpy(zero_copy_only=False)
                    order = np.argsort(known)
                    known, ratio = known[order], ratio[order]
                    urls = list(utf8_rows(rows.column(rows.num_columns - 1)))
                    sizes = np.array([len(u) for u in urls])
                    value = ratio[np.searchsorted(known, grams(urls))]
                    ends = np.concatenate([[0.0], np.cumsum(value)])[np.cumsum(sizes)]
                    sums = np.diff(np.concatenate([[0.0], ends]))
                    out = sums / np.maximum(sizes, 1)
                columns = [*rows.columns[:-1], pa.array(out, type=pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.join(scores, "block", "left").select("rows", "scores").mapInArrow(run, schema)


def calibrate(scored: DataFrame) -> float:
    """Threshold of best balanced accuracy on ``(score, accepted)`` rows; 0 without both kinds.

    Scores are counted on a fixed grid, so the driver gets a bounded histogram.
    """
    clipped = F.least(F.greatest(F.col("score"), F.lit(-BOUND)), F.lit(BOUND))
    rows = (
        scored.groupBy(F.floor(clipped / STEP).alias("bin"), "accepted").count().collect()
    )
    half = int(BOUND / STEP)
    counts = np.zeros((2, 2 * half + 2))
    for r in rows:
        counts[int(r.accepted), r.bin + half] += r["count"]
    total = counts.sum(axis=1)
    if not total.all():
        return 0.0
    below = np.concatenate([[[0.0], [0.0]], np.cumsum(counts, axis=1)], axis=1)
    balanced = (total[1] - below[1]) / total[1] + below[0] / total[0]
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return (int(best[len(best) // 2]) - half) * STEP


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    Where a rule fits it decides; elsewhere a score at or above the threshold is allowed. Null
    and empty URLs score 0. If no URL is labelled by the rules the score is 0 and the threshold
    too, so all others are allowed. Repeated rows come back as they are; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id"), F.col("url").cast("string"))
    host, path = host_and_path(F.col("url"))
    ruled = (
        rows.withColumns({"host": host, "path": path})
        .withColumn("_by", best_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "url", "host", "path", F.col("_by.rule"), F.col("_by.verdict"))
    )
    ruled = ruled.withColumns(
        {"_in": F.col("verdict") == "allow", "_held": F.crc32(F.col("url")) % FOLDS == 0}
    )
    learnt = ruled.where("verdict IS NOT NULL AND NOT _held").select(
        "url", F.col("_in").alias("accepted")
    )
    keep = ("page_id", "host", "path", "rule", "verdict", "_in", "_held")
    with scratch(pages.sparkSession):
        scored = materialize(with_scores(ruled, count_grams(learnt), *keep), "scores", keep=True)
    held = scored.where("verdict IS NOT NULL AND _held")
    threshold = calibrate(held.select("score", F.col("_in").alias("accepted")))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score"
    )
