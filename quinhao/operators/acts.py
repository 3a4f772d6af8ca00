"""Fee and deed sectors together, from one pass over the items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import money_sum
from quinhao.functions.periods import in_period, period_of
from quinhao.operators.deeds import proved_acts
from quinhao.operators.fees import (
    added_up,
    movement_sums,
    sector_names,
    sector_rows,
    transaction_sectors,
)
from quinhao.rules import FEE_STAGE


def act_rows(
    movimento: DataFrame,
    item: DataFrame,
    recepcao: DataFrame,
    transacao: DataFrame,
    grupo: DataFrame,
    pairs: DataFrame,
    sector_groups: DataFrame,
    sector_acts: DataFrame,
    period: int | None = None,
) -> DataFrame:
    """(period, sector, stage, id_usuario, acts, fees) of ``fee_acts`` and ``deed_acts``, not added up.

    Items are summed once per movement: each fee sector and the whole in columns of their own. A
    movement then counts for its reception twice: for the month it was made in, by which fee sectors
    go, and if it is settled for the deeds proved on the reception, whatever the month. Both meet
    those who are credited, the receiving user and the annotating ones, in one join.
    """
    names = sector_names(sector_groups)
    sectors = transaction_sectors(transacao, grupo, sector_groups)
    per_movement = movement_sums(item, sectors, names, "left", money_sum("taxa_1").alias("paid"))
    made = F.when(in_period(F.col("data"), period), period_of(F.col("data")))
    movements = movimento.select(
        "id_mov_caixa",
        "id_recepcao",
        made.alias("month"),
        (F.col("situacao_pgto") == "Liquidado").alias("settled"),
    )
    sums = [c for i in range(len(names)) for c in (f"acts_{i}", f"fees_{i}", f"items_{i}")]
    of_sectors = F.coalesce(*[F.nullif(F.col(f"items_{i}"), F.lit(0)) for i in range(len(names))])
    joined = per_movement.join(movements, "id_mov_caixa")
    kinds = dict(joined.dtypes)

    def use(deed: bool):
        """A movement's row for fee sectors, or for deeds; a null stands for no use."""
        absent = {c: F.lit(None).cast(kinds[c]).alias(c) for c in (*sums, "month", "paid")}
        given = {c: F.col(c) for c in (("paid",) if deed else (*sums, "month"))}
        row = F.struct(F.lit(deed).alias("deed"), *(absent | given).values())
        wanted = F.col("settled") if deed else F.col("month").isNotNull() & of_sectors.isNotNull()
        return F.when(wanted, row)

    per_reception = (
        joined.select("id_recepcao", F.explode(F.array(use(False), use(True))).alias("u"))
        .where("u IS NOT NULL")
        .select("id_recepcao", "u.*")
        .groupBy("id_recepcao", "deed", "month")
        .agg(*added_up(names), money_sum("paid").alias("paid"))
    )
    unknown = {"period": F.lit(None).cast("int"), "sector": F.lit(None).cast("string")}
    receivers = recepcao.select(
        "id_recepcao",
        F.lit(False).alias("deed"),
        *[c.alias(name) for name, c in unknown.items()],
        F.lit(FEE_STAGE).alias("stage"),
        "id_usuario",
    )
    proved = proved_acts(pairs, sector_acts).withColumn("deed", F.lit(True))
    credited = receivers.unionByName(proved.select(receivers.columns))
    deed_row = F.struct(
        F.col("sector"),
        F.lit(1).cast("bigint").alias("acts"),
        F.col("paid").alias("fees"),
        F.lit(1).cast("bigint").alias("items"),
    )
    rows = F.when(F.col("deed"), F.array(deed_row)).otherwise(sector_rows(names))
    return (
        per_reception.join(credited, ["id_recepcao", "deed"])
        .select(
            F.coalesce("period", "month").alias("period"),
            "stage",
            "id_usuario",
            F.explode(rows).alias("r"),
        )
        .where(F.col("r.items") > 0)
        .select("period", "r.sector", "stage", "id_usuario", "r.acts", "r.fees")
    )


def add_up(rows: DataFrame) -> DataFrame:
    """``act_rows`` per (period, sector, stage, user)."""
    return rows.groupBy("period", "sector", "stage", "id_usuario").agg(
        F.sum("acts").cast("double").alias("acts"), money_sum("fees").alias("fees")
    )
