"""The payroll table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao import rules as R
from quinhao.functions.money import half_even
from quinhao.operators.admin import admin_pool, admin_share
from quinhao.operators.allowances import bonus_wide, uplift, with_adjustments
from quinhao.operators.pool import payroll_production
from quinhao.operators.roster import active_roster, signer_allowance
from quinhao.plans.production import active_periods, total_production
from quinhao.rules import BONUS_COLUMNS, PayrollParams
from quinhao.schemas import Inputs, Tables

# Money columns of the payroll, in order; the salary is their sum.
PAY_COLUMNS: tuple[str, ...] = (
    "salario_base",
    "produtividade",
    "adicional_escrevente",
    *BONUS_COLUMNS.values(),
    "horas_extras",
)


def assemble(
    total: DataFrame,
    roster: DataFrame,
    periods: DataFrame,
    rates: DataFrame,
    inputs: Inputs,
    params: PayrollParams = PayrollParams(),
) -> DataFrame:
    """Payroll of everyone on the roster in each period, from finished production.

    What is entered per employee joins the roster before it is repeated for every period.
    Amounts are rounded before attitude and overtime, and the salary is not rounded.
    """
    people = signer_allowance(roster, params.signer_allowance)
    monthly = [df for df in (inputs.bonus_assignment, inputs.adjustments) if "period" in df.columns]
    if not monthly:
        people = bonus_wide(people, inputs.bonus_assignment, rates)
        people = with_adjustments(people, inputs.adjustments)
    paid = payroll_production(total, people, periods)
    if monthly:
        paid = bonus_wide(paid, inputs.bonus_assignment, rates)
        paid = with_adjustments(paid, inputs.adjustments)
    paid = paid.withColumns(
        {
            "salario_base": F.lit(float(params.base_salary)),
            "produtividade": F.col("production"),
        }
    )
    rounded = [c for c in PAY_COLUMNS if c != "horas_extras"]
    paid = uplift(paid.withColumns({c: half_even(F.col(c)) for c in rounded}))
    salary = reduce(add, [F.col(c) for c in PAY_COLUMNS])
    return paid.select(
        "period", "id_usuario", "nome_funcionario", *PAY_COLUMNS, salary.alias("salario")
    )


def run_rates(
    t: Tables,
    inputs: Inputs,
    roster: DataFrame,
    as_of: dt.date | None = None,
    values: Mapping[str, float] | None = None,
) -> DataFrame:
    """(category, value): the set values and the administrative share, unless it is set too."""
    fixed = R.bonus_rates(roster.sparkSession, values)
    if values and "adm" in values:
        return fixed
    pool = admin_pool(t.recibo, t.item_recibo, as_of, bounds=not t.pruned)
    share = admin_share(pool, inputs.bonus_assignment, roster)
    return fixed.unionByName(share.select(F.lit("adm").alias("category"), "value"))


def payroll(
    t: Tables,
    inputs: Inputs,
    period: int | None = None,
    as_of: dt.date | None = None,
    params: PayrollParams = PayrollParams(),
    margins: Mapping[str, float] | None = None,
    values: Mapping[str, float] | None = None,
) -> DataFrame:
    """The full payroll of one period, or of every month with activity.

    ``as_of`` picks the month of the administrative pool (default: today's).
    """
    spark = t.usuario.sparkSession
    roster = active_roster(t.funcionarios, t.usuario)
    return assemble(
        total_production(t, R.sector_rules(spark, margins), period),
        roster,
        active_periods(t, period),
        run_rates(t, inputs, roster, as_of, values),
        inputs,
        params,
    )


def in_report_order(df: DataFrame) -> DataFrame:
    """By period, if there is one, and employee name."""
    return df.orderBy(*[c for c in ("period", "nome_funcionario") if c in df.columns])
