"""From the raw tables to each person's boosted production."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao import rules as R
from quinhao.functions.periods import in_period, period_of
from quinhao.operators.acts import act_rows, add_up
from quinhao.operators.deeds import deed_acts, stage_pairs
from quinhao.operators.fees import fee_acts
from quinhao.operators.lookup import within_bounds
from quinhao.operators.pool import (
    boosted_total,
    sector_production,
    share_out,
    top_boost,
)
from quinhao.schemas import Tables


def active_periods(t: Tables, period: int | None = None) -> DataFrame:
    """Months with a cash movement or a registered book, or just the chosen one."""
    if period is not None:
        return t.livros_notas.sparkSession.sql(
            "SELECT CAST(:period AS INT) AS period", args={"period": period}
        )
    dates = [(t.movimento_caixa, "data"), (t.livros_notas, "data_reg")]
    first, second = (
        df.where(in_period(F.col(c), None)).select(period_of(F.col(c)).alias("period")).distinct()
        for df, c in dates
    )
    return first.union(second).distinct()


def all_fee_acts(t: Tables, period: int | None = None) -> DataFrame:
    item = t.item_movimento_caixa
    if period is not None and not t.pruned:
        month = t.movimento_caixa.where(in_period(F.col("data"), period))
        item = within_bounds(item, month, "id_mov_caixa")
    return fee_acts(
        t.movimento_caixa,
        item,
        t.recepcao_titulo,
        t.transacao_ato,
        t.grupo_ato,
        R.sector_groups(item.sparkSession),
        period,
    )


def all_deed_acts(t: Tables, period: int | None = None) -> DataFrame:
    movimento, item = t.movimento_caixa, t.item_movimento_caixa
    anotacoes, livros = t.recepcao_anotacoes, t.livros_notas
    if period is not None and not t.pruned:
        livros = livros.where(in_period(F.col("data_reg"), period))
        paid = movimento.join(livros.select("id_recepcao"), "id_recepcao", "left_semi")
        item = within_bounds(item, paid, "id_mov_caixa")
        anotacoes = within_bounds(anotacoes, livros, "id_recepcao")
        movimento = within_bounds(movimento, livros, "id_recepcao")
    pairs = stage_pairs(anotacoes, livros, period)
    return deed_acts(movimento, item, pairs, R.sector_acts(livros.sparkSession))


def all_act_rows(t: Tables, period: int | None = None) -> DataFrame:
    """What makes up the acts and fees of all six sectors; the items are read once."""
    movimento, item = t.movimento_caixa, t.item_movimento_caixa
    anotacoes, livros = t.recepcao_anotacoes, t.livros_notas
    if period is not None and not t.pruned:
        livros = livros.where(in_period(F.col("data_reg"), period))
        month = in_period(F.col("data"), period)
        paid = movimento.join(livros.select("id_recepcao"), "id_recepcao", "left_semi")
        keys = movimento.where(month).select("id_mov_caixa").union(paid.select("id_mov_caixa"))
        item = within_bounds(item, keys, "id_mov_caixa")
        anotacoes = within_bounds(anotacoes, livros, "id_recepcao")
        movimento = within_bounds(movimento, livros, "id_recepcao", or_where=month)
    spark = livros.sparkSession
    return act_rows(
        movimento,
        item,
        t.recepcao_titulo,
        t.transacao_ato,
        t.grupo_ato,
        stage_pairs(anotacoes, livros, period),
        R.sector_groups(spark),
        R.sector_acts(spark),
        period,
    )


def all_acts(t: Tables, period: int | None = None) -> DataFrame:
    """Acts and fees of all six sectors, for one period or all."""
    return add_up(all_act_rows(t, period))


def allocation(t: Tables, rules: DataFrame, period: int | None = None) -> DataFrame:
    """Every producer's part of every pool. Nothing runs until the result is used."""
    return share_out(all_act_rows(t, period), rules)


def boosted_production(t: Tables, rules: DataFrame, period: int | None = None) -> DataFrame:
    """Boosted production per (period, sector, producer)."""
    return top_boost(sector_production(allocation(t, rules, period)), rules)


def total_production(t: Tables, rules: DataFrame, period: int | None = None) -> DataFrame:
    """Boosted production per (period, producer)."""
    return boosted_total(allocation(t, rules, period), rules)
