"""The administrative staff's share of the month's archived receipts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import money_sum, net
from quinhao.functions.periods import in_month_of
from quinhao.operators.lookup import within_bounds
from quinhao.rules import ADMIN_SHARE


def admin_pool(
    recibo: DataFrame,
    item_recibo: DataFrame,
    as_of: dt.date | None = None,
    bounds: bool = True,
) -> DataFrame:
    """One row: fees of receipts archived in the month of ``as_of`` (default: this month).

    Items outside the range of the month's receipts are not read; turn these ``bounds`` off where
    the items come from partitions of the month. Items are summed per receipt before they move, so a
    huge receipt is one row in the join.
    """
    archived = recibo.where(
        (F.col("arquivado") == "True") & in_month_of(F.col("data_arquivado"), as_of)
    ).select("id_recibo")
    items = within_bounds(item_recibo, archived, "id_recibo") if bounds else item_recibo
    per_receipt = items.groupBy("id_recibo").agg(money_sum("taxa_1").alias("fees"))
    return per_receipt.join(archived, "id_recibo").agg(money_sum("fees").alias("fees"))


def admin_share(pool: DataFrame, assignments: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: value per weight unit of the administrative allowance.

    The net pool's share is divided by the number of selected employees, at least one. Only
    people on the roster can be selected. A month without receipts is worth zero.
    """
    selected = (
        assignments.where(F.col("category") == "adm")
        .join(roster.select("id_usuario"), "id_usuario", "left_semi")
        .agg(F.countDistinct("id_usuario").alias("n"))
    )
    share = net(F.col("fees")).cast("double") * F.lit(ADMIN_SHARE)
    return pool.select(
        "fees",
        F.greatest(selected.scalar(), F.lit(1)).alias("selected"),
        F.coalesce(share / F.greatest(selected.scalar(), F.lit(1)), F.lit(0.0)).alias("value"),
    )
