"""Allowances, attitude and overtime entered per employee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import or_zero
from quinhao.rules import BONUS_COLUMNS, DEFAULT_ATTITUDE, DEFAULT_OVERTIME


def _keys(people: DataFrame, entries: DataFrame) -> list[str]:
    """Entries with a period apply to that period only, others to every period."""
    if "period" not in entries.columns:
        return ["id_usuario"]
    if "period" not in people.columns:
        raise ValueError("entries carry a period, so the people must be listed per period")
    return ["period", "id_usuario"]


def bonus_wide(people: DataFrame, assignments: DataFrame, rates: DataFrame) -> DataFrame:
    """One allowance column per category: value times weight if selected, else zero."""
    keys = _keys(people, assignments)
    amounts = assignments.join(F.broadcast(rates), "category")  # one rate per category
    amount = F.col("value") * F.col("weight")
    wide = amounts.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("category") == category, amount)).alias(column)
            for category, column in BONUS_COLUMNS.items()
        ]
    )
    return people.join(wide, keys, "left").withColumns(
        {column: or_zero(F.col(column)) for column in BONUS_COLUMNS.values()}
    )


def with_adjustments(people: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Attach attitude and overtime by employee, with defaults where none was entered.

    A person has one entry, or one in a period; a second one stops the run instead of paying
    twice. ``input_violations`` lists such entries beforehand.
    """
    keys = _keys(people, adjustments)
    twice = F.raise_error(
        F.concat(F.lit("more than one adjustment for "), F.concat_ws("/", *keys))
    ).cast("double")
    single = F.count(F.lit(1)) == 1
    entered = adjustments.groupBy(*keys).agg(
        *[F.when(single, F.max(c)).otherwise(twice).alias(c) for c in ("attitude", "overtime")]
    )
    return people.join(entered, keys, "left").withColumns(
        {
            "attitude": F.coalesce(F.col("attitude"), F.lit(DEFAULT_ATTITUDE)),
            "overtime": F.coalesce(F.col("overtime"), F.lit(DEFAULT_OVERTIME)),
        }
    )


def uplift(payroll: DataFrame) -> DataFrame:
    """Raise production by the attitude percentage and pay overtime as entered."""
    produced = F.col("produtividade")
    return payroll.withColumns(
        {
            "produtividade": produced + produced * (F.col("attitude") / 100),
            "horas_extras": F.col("overtime"),
        }
    ).drop("attitude", "overtime")


def adjustments_apply(payroll: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Attach the entries and apply them; production is not rounded again."""
    return uplift(with_adjustments(payroll, adjustments))
