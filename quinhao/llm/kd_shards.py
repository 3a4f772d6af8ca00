"""Shards of near-equal bytes by a k-d tree over document metadata, in DataFrame operations only.

A node with more than one shard left is split along its widest metadata dimension, at the point
that parts its bytes in proportion to the shards on either side. The point is found by counting
bytes in bins of the dimension and counting the one bin that holds it again in finer bins, so no
task sorts a node. Equal texts have one place in the tree: the least of their values in each
dimension, and the text's hash among equal values. So they stay in one shard, unless a cut meets a
group of copies of more than GROUP_SHARE of a shard, which is parted by the documents' hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, scratch

HISTOGRAM = 1 << 16  # bins counted at once over all nodes, at least LEAST_BINS for each
LEAST_BINS = 16
TOLERANCE = 0.002  # of a shard's bytes: a bin that is no larger is not parted
GROUP_SHARE = 0.04  # of a shard's bytes: a group of equal texts that is no larger is not parted
SCALE_BITS, HASH_BITS = 31, 31
KEY_BITS = SCALE_BITS + HASH_BITS
BLOCK_ROWS = 100_000  # rows numbered by one task


def position(text: Column) -> Column:
    """A number that orders strings by their first six bytes; null before all."""
    first = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("double"), F.lit(-1.0))


def default_dimensions() -> dict[str, Column]:
    """Language, source and place in the corpus.

    Not the size: a dimension that gathers the large documents in a few shards leaves little to
    choose a cut from.
    """
    return {
        "lang": position(F.col("lang")),
        "source": position(F.col("source")),
        "doc_id": F.col("doc_id"),
    }


@dataclass
class _Search:
    """Where a node's cut lies: in [low, low + bins * width) of the value or copy key."""

    node: int
    dim: int
    start: float
    span: float
    goal: float  # bytes that should go left
    tolerance: float
    low: int = 0
    end: int = 1 << KEY_BITS
    width: int = 0
    below: int = 0  # bytes before ``low``
    fixed: int | None = None  # value key whose copies are being parted
    cut: tuple[int, int] | None = None


def _values(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    text = ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def _key(dims: Sequence[str]) -> Column:
    """Place of a row in its node's order: scaled dimension, then the text's hash."""
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    top = (1 << SCALE_BITS) - 1
    scaled = F.when(F.col("span") > 0, (value - F.col("start")) / F.col("span") * top).otherwise(0)
    scaled = F.least(F.greatest(F.floor(scaled), F.lit(0)), F.lit(top)).cast("bigint")
    return F.shiftleft(scaled, HASH_BITS).bitwiseOR(F.col("text_hash"))


def _place(search: _Search, counts: Mapping[int, int]) -> None:
    """Narrow a search to the bin that holds its goal, or settle on the nearer of its edges."""
    before = search.below
    number, weight = -1, 0
    for number in sorted(counts):
        weight = counts[number]
        if before + weight >= search.goal:
            break
        before += weight
    low = search.low + max(number, 0) * search.width
    single = search.width == 1  # one value and text, or one copy
    least = GROUP_SHARE / TOLERANCE * search.tolerance if single else search.tolerance
    if weight > least and not (single and search.fixed is not None):
        search.low, search.end, search.below = low, low + search.width, before
        if single:
            search.fixed, search.low, search.end = low, 0, 1 << KEY_BITS
        return
    right = abs(before + weight - search.goal) < abs(search.goal - before)
    edge = low + search.width if right else low
    search.cut = (edge, 0) if search.fixed is None else (search.fixed, edge)


def _find_cuts(state: DataFrame, searches: Sequence[_Search], dims: Sequence[str]) -> None:
    spark = state.sparkSession
    bins = max(LEAST_BINS, HISTOGRAM // len(searches))
    while active := [s for s in searches if s.cut is None]:
        for s in active:
            s.width = max(1, -(-(s.end - s.low) // bins))
        rows = [
            (s.node, s.dim, f"{s.start!r}D", f"{s.span!r}D", f"{s.low}L", f"{s.end}L",
             f"{s.width}L", f"{-1 if s.fixed is None else s.fixed}L")
            for s in active
        ]
        wanted = _values(spark, rows, "first, dim, start, span, low, end, width, fixed")
        key, copy = _key(dims), F.col("doc_hash")
        found = (
            state.join(F.broadcast(wanted), "first")  # a row per node
            .withColumn("key", key)
            .where((F.col("fixed") < 0) | (F.col("key") == F.col("fixed")))
            .withColumn("at", F.when(F.col("fixed") < 0, F.col("key")).otherwise(copy))
            .where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("end")))
            .groupBy("first", F.expr("(at - low) DIV width").alias("bin"))
            .agg(F.sum("size").alias("bytes"))
            .collect()  # at most `bins` rows a node
        )
        counts: dict[int, dict[int, int]] = {s.node: {} for s in active}
        for row in found:
            counts[row["first"]][row["bin"]] = row["bytes"]
        for s in active:
            _place(s, counts[s.node])


def _split(state: DataFrame, searches: Sequence[_Search], dims: Sequence[str]) -> DataFrame:
    rows = [
        (s.node, s.dim, f"{s.start!r}D", f"{s.span!r}D", f"{s.cut[0]}L", f"{s.cut[1]}L")
        for s in searches
    ]
    cuts = _values(state.sparkSession, rows, "first, dim, start, span, cut, copy_cut")
    key, half = _key(dims), F.expr("parts DIV 2")
    at_cut = (key == F.col("cut")) & (F.col("doc_hash") < F.col("copy_cut"))
    left = (key < F.col("cut")) | at_cut
    right = F.col("cut").isNotNull() & ~left
    return state.join(F.broadcast(cuts), "first", "left").select(
        *[c for c in state.columns if c not in ("first", "parts")],
        F.when(right, F.col("first") + half).otherwise(F.col("first")).cast("int").alias("first"),
        F.when(F.col("cut").isNull(), F.col("parts"))
        .when(right, F.col("parts") - half)
        .otherwise(half)
        .cast("int")
        .alias("parts"),
    )


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every row, in shards of near-equal ``size``.

    Either the number of shards or their target bytes is given. ``size`` is the UTF-8 length of
    the text plus 8; null texts have none and the checksum 0. Dimensions are numbers made of
    ``size`` and other columns of ``docs``, null counts as -1. Repeated rows and null ids come
    back as they are; an empty table gives an empty result. Only per-node figures reach the
    driver: a few numbers a node, and histograms of bounded length.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    dimensions = default_dimensions() if dimensions is None else dimensions
    dims = [f"dim_{k}" for k in range(len(dimensions))]
    text = F.col("text").cast("string")
    value = {
        d: F.coalesce(c.cast("double"), F.lit(-1.0)) for d, c in zip(dims, dimensions.values())
    }
    sized = docs.withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint"))
    state = sized.select(
        F.col("doc_id").cast("bigint"),
        "size",
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("text"),
        F.shiftrightunsigned(
            F.xxhash64(F.col("doc_id").cast("bigint"), text), 64 - KEY_BITS
        ).alias("doc_hash"),
        *[c.alias(d) for d, c in value.items()],
    )
    with scratch(docs.sparkSession):
        rows = materialize(state, "kd-rows")
        # a text is one row here however many copies it has, as tasks take the least first; and the
        # engine splits the join's large partitions
        places = rows.groupBy("text", "size").agg(*[F.min(d).alias(d) for d in dims])
        total = rows.agg(F.sum("size")).first()[0] or 0
        parts = shards or max(1, -(-total // target_bytes))
        state = (
            rows.drop(*dims)
            .join(places, ["text", "size"])
            .withColumn("text_hash", F.shiftrightunsigned("text", 64 - HASH_BITS))
            .withColumns({"first": F.lit(0), "parts": F.lit(parts)})
            .drop("text")
        )
        state = materialize(state, "kd-places", keep=parts == 1 or not total)
        ranges: list[float] = []
        while parts > 1:
            found = (
                state.where("parts > 1")
                .groupBy("first", "parts")
                .agg(
                    F.sum("size").alias("bytes"),
                    *[F.min(d).alias(f"{d}_low") for d in dims],
                    *[F.max(d).alias(f"{d}_high") for d in dims],
                )
                .collect()
            )
            spans = [[float(r[f"{d}_high"] - r[f"{d}_low"]) for d in dims] for r in found]
            if not found:  # no rows
                break
            ranges = ranges or spans[0]
            searches = []
            for row, span in zip(found, spans):
                wide = [s / whole if whole else 0.0 for s, whole in zip(span, ranges)]
                dim = wide.index(max(wide))
                share = (row["parts"] // 2) / row["parts"]
                searches.append(
                    _Search(
                        node=row["first"],
                        dim=dim,
                        start=float(row[f"{dims[dim]}_low"]),
                        span=span[dim],
                        goal=row["bytes"] * share,
                        tolerance=row["bytes"] / row["parts"] * TOLERANCE,
                    )
                )
            _find_cuts(state, searches, dims)
            parts = -(-parts // 2)
            state = materialize(_split(state, searches, dims), "kd-level", keep=parts == 1)
    return state.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"))


def with_slots(sharded: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number each shard's rows from 0 without gaps, in ``slot``.

    Rows are numbered in blocks of a shard, each by one task, after the counts of the blocks
    before; so a shard may be of any size.
    """
    known = sharded.agg(F.count(F.lit(1)).alias("n"), F.max("shard").alias("last")).first()
    blocks = max(8, -(-known["n"] // (block_rows * ((known["last"] or 0) + 1))))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")
    placed = sharded.withColumn("_block", block)
    before = (
        Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("shard", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    order = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(order))
        .join(starts, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("bigint"))
        .drop("_block", "_row", "_start")
    )


def shards_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): ``law`` is ``bytes``."""
    return with_slots(kd_shards(docs, shards=shards)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
