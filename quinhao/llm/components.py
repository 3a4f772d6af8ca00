"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.llm.common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, least): each edge with the least of u and all that u is joined with."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    # tasks sum up before the shuffle, and the engine splits the join's large partitions
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is its component's least node.

    Alternates joining each node's larger and smaller neighbours with its least one, until every
    node hangs on its root. Every round is a stored table, so a lost executor repeats one round.
    Loops and repeated edges do no harm.
    """
    edges = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _least(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        met = _least(large)
        small = (
            met.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(met.select("u", F.col("least").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, "edges")
        # a star is done when no node is both a root and hung on another
        open_ends = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        doubled = new.groupBy("u").count().where("count > 1")
        edges = new
        if open_ends.isEmpty() and doubled.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
