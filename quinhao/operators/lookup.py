"""Joins of facts whose keys may be hot, planned without looking at any data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key counts as hot if it holds this share of what a task gets on average; so there are at
# most this many hot keys for each task.
HOT_PER_TASK = 4
# Most keys and counters of the engine's sketch of frequent items (fixed values).
MOST_KEYS, MOST_COUNTERS = 100_000, 1_000_000


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """(key, _hot): keys that hold more than a quarter of what a task gets on average.

    One pass over ``facts`` fills a sketch of frequent items, which tasks merge: a row each moves,
    and no key is counted exactly. The counters are four for each key that may pass, so a hot key
    is always among them; a key whose count is guessed too high is spread without need. Beyond
    25,000 tasks fewer keys can pass.
    """
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = min(HOT_PER_TASK * tasks, MOST_KEYS)
    counters = min(max(4 * keys, 1024), MOST_COUNTERS)
    known = facts.where(F.col(key).isNotNull())
    sketch = known.agg(
        F.expr(f"approx_top_k({key}, {keys}, {counters})").alias("top"),
        F.count(F.lit(1)).alias("whole"),
    )
    return (
        sketch.select("whole", F.explode("top").alias("t"))
        .where(F.col("t.count") * (HOT_PER_TASK * tasks) >= F.col("whole"))
        .select(F.col("t.item").alias(key), F.lit(True).alias("_hot"))
    )


def engine_broadcasts(df: DataFrame) -> bool:
    """Whether the engine's own size estimate lets it broadcast ``df``; starts no job."""
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit.startswith("-"):  # switched off
        return False
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str, by: Sequence[str]
) -> DataFrame:
    """Join ``facts`` with ``lookup`` on ``key``, by "inner" or "left" join.

    A lookup that the engine can broadcast leaves the facts where they are; any other goes
    through ``spread_join``.
    """
    if engine_broadcasts(lookup):
        return facts.join(lookup, key, how)
    return spread_join(facts, lookup, key, how, by)


def spread_join(
    facts: DataFrame, other: DataFrame, key: str, how: str, by: Sequence[str]
) -> DataFrame:
    """Shuffled join in which the facts of a hot key are spread over all tasks.

    The columns ``by`` tell the facts of a key apart: sum equal facts first, or number the rows where
    that would shuffle them once more for little. Only the few rows
    of ``other`` that belong to hot keys are repeated. Facts without a key are spread too. Which
    keys are hot is part of the plan (``hot_keys``), so the facts are read twice.
    """
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = 4 * tasks  # several per task even out the tasks' loads
    hot = F.broadcast(hot_keys(facts, key))
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    spread = F.col("_hot") | F.col(key).isNull()
    salted = facts.join(hot, key, "left").withColumn("_salt", F.when(spread, salt).otherwise(0))
    repeats = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = other.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.coalesce(repeats, F.array(F.lit(0))))
    )
    return (
        salted.drop("_hot")
        .join(repeated.drop("_hot").hint("shuffle_merge"), [key, "_salt"], how)
        .drop("_salt")
    )


def within_bounds(
    facts: DataFrame, keys: DataFrame, key: str, or_where: Column | None = None
) -> DataFrame:
    """Drop ``facts`` whose ``key`` is below the least or above the largest of ``keys``.

    For one month's run over tables without a layout, ahead of an inner join with ``keys``. The
    bounds are scalars that the scan of the facts applies, so row groups of other months are skipped
    where keys grow with time. The join still decides, so the facts kept need not all be known.
    Facts that meet ``or_where`` stay too.
    """
    edges = keys.agg(F.struct(F.min(key).alias("low"), F.max(key).alias("high"))).scalar()
    inside = F.col(key).between(edges["low"], edges["high"])
    return facts.where(inside if or_where is None else or_where | inside)
