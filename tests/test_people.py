"""Roster, administrative share, allowances, entries and range checks."""

import datetime as dt

import pytest
from small import collect, fee, inputs, tables

from quinhao import rules as R
from quinhao.operators.admin import admin_pool, admin_share
from quinhao.operators.allowances import adjustments_apply, bonus_wide
from quinhao.operators.checks import input_violations
from quinhao.operators.pool import payroll_production
from quinhao.operators.roster import active_roster, signer_allowance
from quinhao.plans.payroll import in_report_order, payroll, run_rates

LEFT = dt.date(2020, 1, 1)
PEOPLE = {
    "funcionarios": [
        (1, "Bia", "CLT", None), (2, "Ana", "CLT", None), (3, "Caio", "PJ", None),
        (4, "Duda", "CLT", LEFT), (5, "Edu", "CLT", None), (6, "Fabi", "CLT", None),
    ],
    "usuario": [
        (10, 1, "False", "True"), (20, 2, "False", "False"), (30, 3, "False", "True"),
        (40, 4, "False", "True"), (50, 5, "True", "True"), (70, 7, "False", "True"),
    ],
}


@pytest.fixture
def roster(spark):
    t = tables(spark, **PEOPLE)
    return active_roster(t.funcionarios, t.usuario)


def test_roster(roster):
    rows = [tuple(r) for r in in_report_order(roster).collect()]
    assert rows == [(20, "Ana", 0), (10, "Bia", 1)]


def test_signer_allowance(roster):
    assert collect(signer_allowance(roster, 183.75)) == [(10, "Bia", 183.75), (20, "Ana", 0.0)]


RECEIPTS = {
    "recibo": [
        (1, "True", dt.datetime(2021, 3, 31, 23, 59, 59)),
        (2, "True", dt.datetime(2021, 4, 1)),
        (3, "False", dt.datetime(2021, 3, 2)),
        (4, "True", dt.datetime(2020, 3, 2)),
        (5, "True", None),
    ],
    "item_recibo": [(n, fee(1000 * n)) for n in (1, 1, 2, 3, 4, 5)],
}


@pytest.mark.parametrize(
    "chosen, want", [((10,), 9.715), ((10, 20), 4.8575), ((99,), 9.715), ((), 9.715)]
)
def test_admin_share(spark, roster, chosen, want):
    t = tables(spark, **RECEIPTS)
    pool = admin_pool(t.recibo, t.item_recibo, dt.date(2021, 3, 15))
    assert collect(pool) == [(fee("2000.00"),)]
    assigned = inputs(spark, bonus_assignment=[("adm", u, 1.0) for u in chosen]).bonus_assignment
    (row,) = admin_share(pool, assigned, roster).collect()
    assert row.value == pytest.approx(want, abs=1e-12)
    assert row.selected == max(1, len(set(chosen) & {10, 20}))


def test_admin_share_of_an_empty_month_is_zero(spark, roster):
    t = tables(spark, **RECEIPTS)
    pool = admin_pool(t.recibo, t.item_recibo, dt.date(2021, 5, 1))
    (row,) = admin_share(pool, inputs(spark).bonus_assignment, roster).collect()
    assert (row.fees, row.value) == (None, 0.0)


def test_set_administrative_value_wins(spark, roster):
    rates = run_rates(tables(spark), inputs(spark), roster, values={"adm": 50.0, "esc": 1.0})
    got = {r.category: r.value for r in rates.collect()}
    assert got == {**R.BONUS_VALUES, "adm": 50.0, "esc": 1.0}


def test_bonus_wide(spark, roster):
    assigned = [("esc", 10, 2.0), ("fam", 10, 1.0), ("fam", 20, 3.0), ("ger", 99, 1.0)]
    entered = inputs(spark, bonus_assignment=assigned)
    rates = R.bonus_rates(spark, {"adm": 7.0})
    rows = {r.id_usuario: r for r in bonus_wide(roster, entered.bonus_assignment, rates).collect()}
    assert set(rows) == {10, 20}
    assert rows[10].grat_escrituras == 245.0
    assert rows[20].salario_familia == pytest.approx(153.81)
    assert rows[20].grat_escrituras == rows[10].funcao_gerencia == 0.0


def test_adjustments_have_defaults(spark):
    paid = spark.createDataFrame(
        [(10, 100.0), (20, 100.0)], "id_usuario bigint, produtividade double"
    )
    entered = inputs(spark, adjustments=[(10, 5.0, 12.5)])
    got = collect(adjustments_apply(paid, entered.adjustments))
    assert got == [(10, pytest.approx(105.0), 12.5), (20, pytest.approx(101.0), 0.0)]


def test_idle_people_are_paid_in_every_month(spark, roster):
    total = spark.createDataFrame(
        [(202103, 10, 5.0), (202104, 99, 7.0)], "period int, id_usuario bigint, production double"
    )
    months = spark.createDataFrame([(202103,), (202104,)], "period int")
    rows = collect(payroll_production(total, roster, months), "period", "id_usuario", "production")
    assert rows == [(202103, 10, 5.0), (202103, 20, 0.0), (202104, 10, 0.0), (202104, 20, 0.0)]


def test_payroll_of_a_month_without_any_work(spark):
    rows = payroll(tables(spark, **PEOPLE), inputs(spark), period=202107, values={"adm": 0.0})
    got = collect(rows, "period", "nome_funcionario", "produtividade", "salario")
    assert got == [(202107, "Ana", 0.0, 1225.0), (202107, "Bia", 0.0, 1408.75)]


def test_input_violations(spark):
    found = input_violations(
        {
            "sector_rules": R.sector_rules(spark, {"esc": 5.1, "inv": 5.0, "proc": 0.05}),
            "payroll_params": R.payroll_params(spark, R.PayrollParams(3000.01, 99.0), 201912),
            "bonus_rates": R.bonus_rates(spark, {"ger": 2000.5}),
            "bonus_assignment": inputs(
                spark, bonus_assignment=[("esc", 1, 0.9), ("fam", 2, 10.0)]
            ).bonus_assignment,
            "adjustments": inputs(
                spark, adjustments=[(1, 6.0, -1.0), (2, 5.0, 1000.0)]
            ).adjustments,
        }
    )
    assert found.where("problem <> 'range'").count() == 0
    assert collect(found, "table", "key", "column", "value") == [
        ("adjustments", "1", "attitude", 6.0),
        ("adjustments", "1", "overtime", -1.0),
        ("bonus_assignment", "esc/1", "weight", 0.9),
        ("bonus_rates", "ger", "value", 2000.5),
        ("payroll_params", "", "base_salary", 3000.01),
        ("payroll_params", "", "signer_allowance", 99.0),
        ("payroll_params", "", "year", 2019.0),
        ("sector_rules", "esc/conf", "margin", 5.1),
        ("sector_rules", "esc/lav", "margin", 5.1),
        ("sector_rules", "proc/lav", "margin", 0.05),
    ]


def test_what_the_form_would_not_let_through(spark, roster):
    """Empty values, second entries, unknown categories and people, and years out of range."""
    assigned = spark.createDataFrame(
        [(202103, "esc", 10, 1.0), (202104, "esc", 10, 1.0), (202103, "fam", 20, None),
         (202103, "bonus", 20, 1.0), (202103, None, 20, 1.0), (203101, "esc", 77, 1.0)],
        "period int, category string, id_usuario bigint, weight double",
    )
    adjusted = inputs(
        spark, adjustments=[(10, 1.0, 0.0), (10, 2.0, 0.0), (None, 1.0, 0.0), (20, None, 1.0)]
    ).adjustments
    found = input_violations(
        {"bonus_assignment": assigned, "adjustments": adjusted}, roster=roster
    )
    assert collect(found, "table", "key", "problem", "column", "value") == [
        ("adjustments", "10", "repeated", "entries", 2.0),
        ("adjustments", "20", "missing", "attitude", None),
        ("adjustments", "?", "off roster", "id_usuario", None),
        ("bonus_assignment", "202103/?/20", "unknown", "category", None),
        ("bonus_assignment", "202103/bonus/20", "unknown", "category", None),
        ("bonus_assignment", "202103/fam/20", "missing", "weight", None),
        ("bonus_assignment", "203101/esc/77", "off roster", "id_usuario", None),
        ("bonus_assignment", "203101/esc/77", "range", "year", 2031.0),
    ]


def test_a_second_adjustment_stops_the_run(spark):
    paid = spark.createDataFrame([(10, 100.0)], "id_usuario bigint, produtividade double")
    entered = inputs(spark, adjustments=[(10, 5.0, 12.5), (10, 5.0, 12.5)])
    with pytest.raises(Exception, match="more than one adjustment for 10"):
        adjustments_apply(paid, entered.adjustments).collect()


def test_unknown_names_of_rules_are_errors(spark):
    with pytest.raises(ValueError, match="no such sector"):
        R.sector_rules(spark, {"autt": 2.0})
    with pytest.raises(ValueError, match="no such category"):
        R.bonus_rates(spark, {"bonus": 2.0})


def test_apostilles_follow_the_margin_of_authentications(spark):
    margins = {(r.sector, r.stage): r.margin for r in R.sector_rules(spark, {"aut": 2.0}).collect()}
    assert margins[("apo", "fee")] == margins[("aut", "fee")] == 2.0
