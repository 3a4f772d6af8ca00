"""Exact copies found by recipes of content-defined chunks, in DataFrame operations only.

A text is cut into pieces (a word with the white space after it, 32 characters of a longer one), and
a chunk ends after a piece whose hash says so, every 128th on average, or MOST pieces after the
last one did. Equal chunks of a task are put together before anything moves, so text that many
documents share moves once from each task; what remains of a document after that is its recipe, the
list of its chunks' identifiers, at about a hundredth of its size. Copies are rows with equal
recipes.

Identifiers are verified: where two different chunks have one hash, they are numbered, and the
number is part of the identifier. So equal recipes mean equal texts, whatever the hash does.

Defined for every row: a null text is empty, and empty texts are copies of each other; ids may be
null or repeat, and the largest id of a group stays, with all rows that have it; a group without
any id keeps all its rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import materialize, scratch
from quinhao.operators.lookup import HOT_PER_TASK

PIECE = r"\S{1,32}\s{0,8}|\s{1,8}"  # every character is in one match
EVERY = 128  # pieces in a chunk, on average
MOST = 1024  # pieces in a chunk


def cut_chunks(docs: DataFrame, *columns: str | Column, hash_bits: int = 64) -> DataFrame:
    """``columns`` of ``docs`` with ``chunks``, the parts of the text in order, and their ``hashes``.

    Fewer ``hash_bits`` make different chunks meet, which changes no result. Store the result before
    it is read twice: a filter moved below these steps would repeat them for every piece.
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    pieces = docs.select(*columns, whole).select(
        "*", F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0)).alias("_pieces")
    )
    hits = F.expr(
        f"""filter(transform(_pieces, (p, i) ->
              CASE WHEN i + 1 = size(_pieces) OR pmod(xxhash64(p), {EVERY}) = 0 THEN i + 1 END),
              e -> e IS NOT NULL)"""
    )
    ends = F.expr(  # a long way to the next hit is cut into equal steps from the last one
        f"""flatten(transform(_hits, (e, k) ->
              CASE WHEN e - coalesce(get(_hits, k - 1), 0) <= {MOST} THEN array(e)
                ELSE concat(sequence(coalesce(get(_hits, k - 1), 0) + {MOST}, e - 1, {MOST}),
                            array(e)) END))"""
    )
    chunks = F.expr(
        """transform(_ends, (e, k) ->
             array_join(slice(_pieces, coalesce(get(_ends, k - 1), 0) + 1,
                              e - coalesce(get(_ends, k - 1), 0)), ''))"""
    )
    short = f"shiftright(xxhash64(c), {64 - hash_bits})"
    return (
        pieces.select("*", hits.alias("_hits"))
        .select("*", ends.alias("_ends"))
        .select("*", chunks.alias("chunks"))
        .select("*", F.expr(f"transform(chunks, c -> {short})").alias("hashes"))
        .drop("_text", "_pieces", "_hits", "_ends")
    )


def chunk_store(chunked: DataFrame) -> DataFrame:
    """(hash, chunk, uses): every different chunk once. Tasks put their own together first."""
    used = chunked.select(F.explode_outer(F.arrays_zip("hashes", "chunks")).alias("c"))
    return used.where("c IS NOT NULL").groupBy(F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("chunk")).agg(
        F.count(F.lit(1)).alias("uses")
    )


def recipes(chunked: DataFrame) -> DataFrame:
    """``chunked`` with ``numbers`` in place of the chunks: what tells chunks of one hash apart.

    ``numbers`` lists (place, number) of a text's chunks whose hash other chunks have too, so it is
    empty nearly always; with ``hashes`` it identifies the text. Needs ``row``, unique for each row.
    """
    crowded = materialize(
        chunk_store(chunked).groupBy("hash").count().where("count > 1").select("hash"), "crowded"
    )
    none = F.expr("CAST(array() AS array<struct<place:int,number:int>>)")
    plain = chunked.drop("chunks")
    if crowded.isEmpty():
        return plain.withColumn("numbers", none)
    uses = (
        chunked.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("place", "c"))
        .select("row", "place", F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("chunk"))
        .join(crowded, "hash", "left_semi")
    )
    # chunks of one hash are few: a group of them is as large as the hash is bad
    named = (
        uses.groupBy("hash", "chunk")
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("hash")
        .agg(F.array_sort(F.collect_list("chunk")).alias("all"))
        .select("hash", F.posexplode("all").alias("number", "chunk"))
    )
    numbered = (
        uses.join(named, ["hash", "chunk"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("numbers"))
    )
    return plain.join(numbered, "row", "left").withColumn("numbers", F.coalesce("numbers", none))


def copies(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    The texts are read once: their chunks are stored, and grouping reads recipes only. Groups are
    joined back by recipe; the documents of a group that holds more than a quarter of what a task
    gets on average are spread over all tasks, and there are at most four such groups for each.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark):
        digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
        chunked = materialize(
            cut_chunks(
                docs, "doc_id", digest.alias("text_sha256"),
                F.monotonically_increasing_id().alias("row"), hash_bits=hash_bits,
            ), "chunks",
        )
        recipe = ["key", "hashes", "numbers"]
        texts = recipes(chunked).withColumn("key", F.xxhash64("hashes", "numbers"))
        groups = materialize(
            texts.groupBy(*recipe)
            .agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"),
            "groups",
        )
        least = chunked.count() / (HOT_PER_TASK * tasks)
        hot = F.broadcast(  # at most HOT_PER_TASK for each task, 9 bytes each
            groups.where(F.col("group_size") >= least)
            .select("key", F.lit(True).alias("hot"))
            .distinct()
        )
        salts = 4 * tasks
        mine = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(0)
        each = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
        spread = texts.join(hot, "key", "left").withColumn("salt", mine.cast("int")).drop("hot")
        repeated = (
            groups.join(hot, "key", "left")
            .withColumn("salt", F.explode(F.coalesce(each, F.array(F.lit(0)))))
            .drop("hot")
        )
        one = F.col("group_size").isNull()
        keep = F.when(one, F.col("doc_id")).otherwise(F.col("top"))
        result = spread.join(repeated, [*recipe, "salt"], "left").select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )
        return materialize(result, "copies", keep=True)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = (
        copies(docs.select("doc_id", "text"))
        .where("kept")
        .select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text"))
        .distinct()
    )
    digest = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (digest == kept["_kept_text"])
    return docs.join(kept, same, "left_semi")


def restored(chunked: DataFrame, store: DataFrame) -> DataFrame:
    """(row, text) put together again from ``hashes`` and a chunk store without crowded hashes."""
    places = chunked.select("row", F.posexplode_outer("hashes").alias("place", "hash"))
    parts = places.join(store.select("hash", "chunk"), "hash", "left").groupBy("row")
    return parts.agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("c")).select(
        "row", F.array_join("c.chunk", "").alias("text")
    )
