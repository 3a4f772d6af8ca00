"""Splitting each sector's net fees among its producers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quinhao.functions.money import money_sum, net, or_zero
from quinhao.rules import SECTORS, TOP_FACTOR

POOL = ["period", "sector", "stage"]

# Totals and maxima hold one row per calendar month, sector and stage: their size depends on
# the calendar and the rules, not on the rows behind them, so they may be broadcast.


def sector_totals(acts: DataFrame) -> DataFrame:
    """Gross fees, net fees and acts per (period, sector, stage)."""
    return (
        acts.groupBy("period", "sector", "stage")
        .agg(money_sum("fees").alias("fees"), F.sum("acts").alias("total_acts"))
        .withColumn("net", net(F.col("fees")))
    )


def pool_allocation(acts: DataFrame, totals: DataFrame, rules: DataFrame) -> DataFrame:
    """Each producer's part: net fees times share of acts times margin percent.

    ``acts`` holds every producer, on the roster or not. For totals that exist already; where they
    come from the same acts, ``share_out`` reads these once.
    """
    both = acts.select(*POOL, "id_usuario", "acts").join(
        F.broadcast(totals.select(*POOL, "total_acts", "net")), POOL
    )
    return _shares(both, rules)


def share_out(acts: DataFrame, rules: DataFrame) -> DataFrame:
    """``pool_allocation`` by the acts' own totals, from rows that may still have to be added up."""
    return _shares(with_totals(acts), rules)


def with_totals(acts: DataFrame) -> DataFrame:
    """Acts per (period, sector, stage, user), with net fees and acts of their pool beside them.

    One aggregation yields producers and totals together, so ``acts`` is read once. A total then
    goes to every slice of its pool, and producers meet it in the slice that their id is dealt to:
    the window over a slice holds a part of a pool's producers, however many these are.
    """
    slices = int(acts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool, user = [F.col(c) for c in POOL], F.col("id_usuario")
    whole = F.col("_whole") == 1
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    own = F.array(F.pmod(F.xxhash64(user), F.lit(slices)).cast("int"))
    dealt = (
        acts.groupingSets([[*pool, user], pool], *pool, user)
        .agg(
            F.sum("acts").cast("double").alias("acts"),
            money_sum("fees").alias("fees"),
            F.grouping("id_usuario").alias("_whole"),
        )
        .withColumn("_slice", F.explode(F.when(whole, every).otherwise(own)))
    )
    there = Window.partitionBy(*POOL, "_slice")
    return (
        dealt.withColumns(
            {
                "total_acts": F.max(F.when(whole, F.col("acts"))).over(there),
                "net": net(F.max(F.when(whole, F.col("fees"))).over(there)),
            }
        )
        .where(~whole)
        .select(*POOL, "id_usuario", "acts", "total_acts", "net")
    )


def _shares(rows: DataFrame, rules: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("acts"), F.col("total_acts"))
    return rows.join(
        F.broadcast(rules.select("sector", "stage", "margin")), ["sector", "stage"]
    ).select(
        *POOL,
        "id_usuario",
        "acts",
        (F.col("net").cast("double") * share * F.col("margin") / 100).alias("production"),
    )


def sector_production(allocation: DataFrame) -> DataFrame:
    """Add the stages of a sector per producer."""
    return allocation.groupBy("period", "sector", "id_usuario").agg(
        or_zero(F.sum("production")).alias("production")
    )


def top_boost(production: DataFrame, rules: DataFrame, factor: float = TOP_FACTOR) -> DataFrame:
    """Boost the largest production of each boosted sector, all ties included.

    The maximum is an aggregate joined back, not a window: a window would bring a whole sector
    into one task.
    """
    boosted = rules.where("boosted").select("sector").distinct()
    top = production.groupBy("period", "sector").agg(F.max("production").alias("top"))
    top = top.join(F.broadcast(boosted), "sector")
    value = F.col("production")
    return production.join(F.broadcast(top), ["period", "sector"], "left").select(
        "period",
        "sector",
        "id_usuario",
        F.when(value == F.col("top"), value * F.lit(factor)).otherwise(value).alias("production"),
    )


def production_total(boosted: DataFrame, sectors: Sequence[str] = SECTORS) -> DataFrame:
    """Production per (period, producer), the sectors added in a fixed order."""
    parts = boosted.groupBy("period", "id_usuario").agg(
        *[
            or_zero(F.sum(F.when(F.col("sector") == s, F.col("production")))).alias(s)
            for s in sectors
        ]
    )
    total = F.lit(0.0)
    for sector in sectors:
        total = total + F.col(sector)
    return parts.select("period", "id_usuario", total.alias("production"))


def boosted_total(
    allocation: DataFrame,
    rules: DataFrame,
    sectors: Sequence[str] = SECTORS,
    factor: float = TOP_FACTOR,
) -> DataFrame:
    """``sector_production``, ``top_boost`` and ``production_total`` in one step.

    The same numbers with the sectors as columns, so that the shares are shuffled by period and
    producer only, instead of once per sector and then once more to add the sectors.
    """
    boosted = {row.sector for row in rules.where("boosted").select("sector").collect()}
    wide = allocation.groupBy("period", "id_usuario").agg(
        *[
            F.sum(F.when(F.col("sector") == s, or_zero(F.col("production")))).alias(s)
            for s in sectors
        ]
    )
    # all maxima, also where nothing is boosted: then both sides of the join need the same sums,
    # and the engine makes these once
    tops = wide.groupBy("period").agg(*[F.max(s).alias(f"top_{s}") for s in sectors])
    total = F.lit(0.0)
    for s in sectors:
        value, times = F.col(s), F.lit(factor if s in boosted else 1.0)
        value = F.when(value == F.col(f"top_{s}"), value * times).otherwise(value)
        total = total + or_zero(value)
    return wide.join(F.broadcast(tops), "period").select(
        "period", "id_usuario", total.alias("production")
    )


def payroll_production(total: DataFrame, roster: DataFrame, periods: DataFrame) -> DataFrame:
    """Production of everyone on the roster in each of ``periods``; the idle get zero.

    ``periods`` holds calendar months, which are few. A null id meets nobody. That is told by the
    roster's side alone: the engine would push a plain key's test for nulls below the maxima's other
    reading of the same sums, and make the acts twice.
    """
    months = periods.agg(F.collect_set("period")).scalar()
    spine = roster.select("*", F.explode(months).alias("period"))
    keys = ["period", "id_usuario"]
    made = total.withColumnsRenamed({c: f"_{c}" for c in keys})
    user = F.col("id_usuario")
    same = (F.col("period") == F.col("_period")) & user.eqNullSafe(F.col("_id_usuario"))
    others = [c for df in (spine, total) for c in df.columns if c not in keys]
    return (
        spine.join(made, same & user.isNotNull(), "left")
        .select(*keys, *others)
        .withColumn("production", or_zero(F.col("production")))
    )
