"""Deed sectors: work proved by an annotation on a reception with an opened book."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import money_sum
from quinhao.functions.periods import in_period, period_of
from quinhao.rules import STAGE_PREFIXES

LIST_SPAN = 1000


def stage_pairs(
    anotacoes: DataFrame,
    livros: DataFrame,
    period: int | None = None,
    prefixes: Mapping[str, str] = STAGE_PREFIXES,
) -> DataFrame:
    """Live annotations met with opened books, one row per (period, stage, reception).

    ``annotations`` and ``books`` count the two sides; their product is the number of pairs,
    which are never listed. Where there is just one pair, ``id_usuario`` and ``ato`` are its
    annotating user and act code; elsewhere they are null.
    """
    user, text = F.col("id_usuario"), F.col("anotacao")
    per_stage = {stage: text.startswith(prefix) for stage, prefix in prefixes.items()}
    matches = F.lit(False)
    for is_stage in per_stage.values():
        matches = matches | is_stage
    noted = (
        anotacoes.where((F.col("excluido") == "False") & matches)
        .groupBy("id_recepcao")
        .agg(
            *[F.count_if(m).alias(f"{stage}_n") for stage, m in per_stage.items()],
            *[F.min(F.when(m, user)).alias(f"{stage}_user") for stage, m in per_stage.items()],
        )
    )
    booked = (
        livros.where(
            F.col("id_livro_inicio").isNotNull() & in_period(F.col("data_reg"), period)
        )
        .groupBy("id_recepcao", period_of(F.col("data_reg")).alias("period"))
        .agg(F.count(F.lit(1)).alias("books"), F.min("ato").alias("ato"))
    )
    stages = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(stage).alias("stage"),
                    F.col(f"{stage}_n").alias("annotations"),
                    F.col(f"{stage}_user").alias("id_usuario"),
                )
                for stage in prefixes
            ]
        )
    )
    single = (F.col("s.annotations") == 1) & (F.col("books") == 1)
    return (
        noted.join(booked, "id_recepcao")
        .select("id_recepcao", "period", "books", "ato", stages.alias("s"))
        .where(F.col("s.annotations") > 0)
        .select(
            "period",
            F.col("s.stage").alias("stage"),
            "id_recepcao",
            F.col("s.annotations").alias("annotations"),
            "books",
            F.when(single, F.col("s.id_usuario")).alias("id_usuario"),
            F.when(single, F.col("ato")).alias("ato"),
        )
    )


def _single():
    return (F.col("annotations") == 1) & (F.col("books") == 1)


def ambiguous_receptions(pairs: DataFrame) -> DataFrame:
    """Receptions with more than one pair in a period and stage, whatever their act code."""
    wide = "decimal(19,0)"  # the product of two large counts may pass a bigint
    return pairs.where(~_single()).select(
        "period",
        "stage",
        "id_recepcao",
        (F.col("annotations").cast(wide) * F.col("books").cast(wide)).alias("quantidade"),
    )


def ambiguous_list(pairs: DataFrame, span: int = LIST_SPAN) -> DataFrame:
    """Ambiguous receptions as comma-separated lists, '0' where there is none.

    One list per period, stage and block of ``span`` consecutive reception ids: a reception is
    in ``pairs`` once per period and stage, so no list holds more than ``span`` ids.
    """
    ids = F.expr(
        "listagg(CASE WHEN annotations > 1 OR books > 1 THEN CAST(id_recepcao AS STRING) END, ',')"
        " WITHIN GROUP (ORDER BY id_recepcao)"
    )
    return pairs.groupBy(
        "period", "stage", F.expr(f"id_recepcao DIV {int(span)}").alias("block")
    ).agg(F.coalesce(ids, F.lit("0")).alias("receptions"))


def proved_acts(pairs: DataFrame, sector_acts: DataFrame) -> DataFrame:
    """(period, sector, stage, reception, user): unambiguous receptions in a deed sector."""
    return (
        pairs.where(_single())
        .join(F.broadcast(sector_acts), ["stage", "ato"])  # the rules' codes: a short list
        .select("period", "sector", "stage", "id_recepcao", "id_usuario")
    )


def settled_movements(movimento: DataFrame) -> DataFrame:
    return movimento.where(F.col("situacao_pgto") == "Liquidado").select(
        "id_mov_caixa", "id_recepcao"
    )


def deed_acts(
    movimento: DataFrame,
    item: DataFrame,
    pairs: DataFrame,
    sector_acts: DataFrame,
) -> DataFrame:
    """Acts and fees per (period, sector, stage, annotating user).

    An act is a reception; ambiguous receptions do not count for anyone. A reception left in
    ``pairs`` has one pair, so counting rows counts distinct receptions. Movements are cut to the
    receptions that some act was proved on before their items are joined.
    """
    proved = proved_acts(pairs, sector_acts)
    counted = settled_movements(movimento).join(
        proved.select("id_recepcao").distinct(), "id_recepcao", "left_semi"
    )
    per_movement = item.groupBy("id_mov_caixa").agg(money_sum("taxa_1").alias("fees"))
    per_reception = (
        per_movement.join(counted, "id_mov_caixa")
        .groupBy("id_recepcao")
        .agg(money_sum("fees").alias("fees"))
    )
    return (
        per_reception.join(proved, "id_recepcao")
        .groupBy("period", "sector", "stage", "id_usuario")
        .agg(
            F.count(F.lit(1)).cast("double").alias("acts"),
            money_sum("fees").alias("fees"),
        )
    )
