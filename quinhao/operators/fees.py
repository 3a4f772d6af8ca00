"""Fee sectors: work proved by the fee group of each item in a cash movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import MONEY, money_sum
from quinhao.functions.periods import in_period, period_of
from quinhao.operators.lookup import engine_broadcasts, lookup_join
from quinhao.rules import FEE_STAGE


def transaction_sectors(
    transacao: DataFrame, grupo: DataFrame, sector_groups: DataFrame
) -> DataFrame:
    """(id_transacao, sector) of the transactions whose fee group is known and in a sector."""
    groups = grupo.join(F.broadcast(sector_groups), "codigo").select("codigo").distinct()
    # distinct and among the rules' own codes, so a short list however large the tables
    code = F.col("esat_grat_codigo")
    pairs = [F.lit(x) for r in sector_groups.collect() for x in (r.codigo, r.sector)]
    return transacao.join(F.broadcast(groups), code == F.col("codigo"), "left_semi").select(
        "id_transacao", F.element_at(F.create_map(*pairs), code).alias("sector")
    )


def fee_acts(
    movimento: DataFrame,
    item: DataFrame,
    recepcao: DataFrame,
    transacao: DataFrame,
    grupo: DataFrame,
    sector_groups: DataFrame,
    period: int | None = None,
) -> DataFrame:
    """Acts and fees per (period, sector, receiving user), for one period or all.

    Sums are taken before each join's shuffle: items per movement, movements per reception. So
    a movement or reception that holds much of the data is a few rows once it moves. The few
    sectors are columns until the end, which keeps one row per movement and lets the join with
    the movements reuse the partitioning of their sums.
    """
    sectors = transaction_sectors(transacao, grupo, sector_groups)
    names = sector_names(sector_groups)
    per_movement = movement_sums(item, sectors, names, "inner")
    dated = movimento.where(in_period(F.col("data"), period)).select(
        "id_mov_caixa", "id_recepcao", period_of(F.col("data")).alias("period")
    )
    added = added_up(names)
    per_reception = (
        per_movement.join(dated, "id_mov_caixa").groupBy("id_recepcao", "period").agg(*added)
    )
    per_user = (
        per_reception.join(recepcao.select("id_recepcao", "id_usuario"), "id_recepcao")
        .groupBy("period", "id_usuario")
        .agg(*added)
    )
    return (
        per_user.select("period", "id_usuario", F.inline(sector_rows(names)))
        .where(F.col("items") > 0)
        .select(
            "period",
            "sector",
            F.lit(FEE_STAGE).alias("stage"),
            "id_usuario",
            F.col("acts").cast("double").alias("acts"),
            "fees",
        )
    )


def sector_names(sector_groups: DataFrame) -> list[str]:
    return sorted({row.sector for row in sector_groups.select("sector").collect()})


def movement_sums(
    item: DataFrame, sectors: DataFrame, names: list[str], how: str, *more: Column
) -> DataFrame:
    """Per movement: acts, fees and number of the items of each sector, in columns of its own.

    An "inner" join leaves out items of no sector; a "left" one keeps them for the sums ``more``.
    """
    items = item.select("id_mov_caixa", "id_transacao", "qtde_ato", "taxa_1")
    items = items.withColumn("items", F.lit(1))
    if not engine_broadcasts(sectors):  # the items move: once, as spread rows need no sums first
        items = items.withColumn("_row", F.monotonically_increasing_id())
    of_sector = [c for i, name in enumerate(names) for c in _sums_of(i, F.col("sector") == name)]
    return (
        lookup_join(items, sectors, "id_transacao", how, by=["_row"])
        .groupBy("id_mov_caixa")
        .agg(*of_sector, *more)
    )


def added_up(names: list[str]) -> list[Column]:
    """The columns of ``movement_sums``, added up."""
    return [c for i in range(len(names)) for c in _added(i)]


def sector_rows(names: list[str]) -> Column:
    """The columns of ``movement_sums`` as an array of (sector, acts, fees, items)."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("sector"),
                F.col(f"acts_{i}").alias("acts"),
                F.col(f"fees_{i}").alias("fees"),
                F.col(f"items_{i}").alias("items"),
            )
            for i, name in enumerate(names)
        ]
    )


def _lines(item: DataFrame) -> DataFrame:
    """Items added up per movement and transaction."""
    return item.groupBy("id_mov_caixa", "id_transacao").agg(
        F.sum("qtde_ato").alias("qtde_ato"),
        money_sum("taxa_1").alias("taxa_1"),
        F.count(F.lit(1)).alias("items"),
    )


def _sums_of(i: int, member: Column) -> list[Column]:
    """Acts, fees and number of the items of sector number ``i``."""
    return [
        F.sum(F.when(member, F.col("qtde_ato"))).alias(f"acts_{i}"),
        F.sum(F.when(member, F.col("taxa_1"))).cast(MONEY).alias(f"fees_{i}"),
        F.sum(F.when(member, F.col("items"))).alias(f"items_{i}"),
    ]


def _added(i: int) -> list[Column]:
    return [
        F.sum(f"acts_{i}").alias(f"acts_{i}"),
        money_sum(f"fees_{i}").alias(f"fees_{i}"),
        F.sum(f"items_{i}").alias(f"items_{i}"),
    ]


def movement_enriched(
    movimento: DataFrame,
    item: DataFrame,
    recepcao: DataFrame,
    transacao: DataFrame,
    grupo: DataFrame,
    period: int | None = None,
) -> DataFrame:
    """Fees per (period, reception, user, transaction), with the fee group where there is one.

    Items of a transaction without a group, or of none, stay with a null ``codigo``. A movement
    or reception may have very many transactions, so both joins spread hot keys.
    """
    known = transacao.join(
        grupo.select(F.col("codigo").alias("esat_grat_codigo")), "esat_grat_codigo", "left_semi"
    ).select("id_transacao", F.col("esat_grat_codigo").alias("codigo"))
    lines = _lines(item.select("id_mov_caixa", "id_transacao", "qtde_ato", "taxa_1"))
    dated = movimento.where(in_period(F.col("data"), period)).select(
        "id_mov_caixa", "id_recepcao", period_of(F.col("data")).alias("period")
    )
    per_reception = (
        lookup_join(lines, dated, "id_mov_caixa", "inner", by=["id_transacao"])
        .groupBy("id_recepcao", "period", "id_transacao")
        .agg(
            F.sum("qtde_ato").alias("acts"),
            money_sum("taxa_1").alias("fees"),
            F.sum("items").alias("items"),
        )
    )
    received = lookup_join(
        per_reception,
        recepcao.select("id_recepcao", "id_usuario"),
        "id_recepcao",
        "inner",
        by=["id_transacao", "period"],
    )
    return lookup_join(
        received, known, "id_transacao", "left", by=["id_recepcao", "period"]
    ).select(
        "period", "id_recepcao", "id_usuario", "id_transacao", "codigo", "acts", "fees", "items"
    )
