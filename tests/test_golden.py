"""The worked example: ties, a top producer off the roster, an exempt sector, an idle employee."""

import pytest
from small import inputs

from quinhao import rules as R
from quinhao.operators import pool
from quinhao.plans.payroll import assemble

PERIOD = 202103
ACTS = [
    ("aut", "fee", 10, 4.0, 100), ("aut", "fee", 20, 4.0, 300), ("aut", "fee", 30, 2.0, 100),
    ("apo", "fee", 10, 1.0, 200),
    ("esc", "lav", 10, 3.0, 600), ("esc", "lav", 20, 1.0, 200), ("esc", "conf", 20, 2.0, 400),
    ("proc", "lav", 99, 8.0, 800), ("proc", "lav", 10, 2.0, 200),
    ("dec", "lav", 20, 1.0, 50),
]


@pytest.fixture(scope="module")
def acts(spark):
    return spark.createDataFrame(
        [(PERIOD, *row) for row in ACTS],
        "period int, sector string, stage string, id_usuario bigint, acts double, fees int",
    ).selectExpr("period", "sector", "stage", "id_usuario", "acts",
                 "CAST(fees AS DECIMAL(28,2)) AS fees")


@pytest.fixture(scope="module")
def boosted(spark, acts):
    rules = R.sector_rules(spark)
    allocation = pool.pool_allocation(acts, pool.sector_totals(acts), rules)
    return pool.top_boost(pool.sector_production(allocation), rules)


def test_production_per_sector(boosted):
    got = {(r.sector, r.id_usuario): r.production for r in boosted.collect()}
    want = {
        ("aut", 10): 5.5825, ("aut", 20): 5.5825, ("aut", 30): 2.5375,
        ("apo", 10): 5.075,
        ("esc", 10): 7.1775, ("esc", 20): 6.525,
        ("proc", 99): 28.71, ("proc", 10): 6.525,
        ("dec", 20): 1.595,
    }
    assert got == pytest.approx(want, abs=1e-9)


def test_totals_per_user(boosted):
    got = {r.id_usuario: r.production for r in pool.production_total(boosted).collect()}
    assert got == pytest.approx({10: 24.36, 20: 13.7025, 30: 2.5375, 99: 28.71}, abs=1e-9)


def payroll_rows(spark, boosted, entered):
    roster = spark.createDataFrame(
        [(30, "Ana", 1), (10, "Bia", 0), (20, "Caio", 1), (40, "Duda", 0)],
        "id_usuario bigint, nome_funcionario string, assina int",
    )
    months = spark.createDataFrame([(PERIOD,)], "period int")
    rates = R.bonus_rates(spark, {"adm": 100.125})
    total = pool.production_total(boosted)
    return {
        r.nome_funcionario: r for r in assemble(total, roster, months, rates, entered).collect()
    }


WANT = {
    "Ana": (1225.0, 2.5654, 183.75, 0.0, 918.75, 0.0, 2330.0654),
    "Bia": (1225.0, 24.8472, 0.0, 100.12, 0.0, 10.0, 1359.9672),
    "Caio": (1225.0, 14.385, 183.75, 0.0, 0.0, 0.0, 1423.135),
    "Duda": (1225.0, 0.0, 0.0, 0.0, 0.0, 55.5, 1280.5),
}
SHOWN = (
    "salario_base", "produtividade", "adicional_escrevente", "prod_administrativo",
    "grat_comite", "horas_extras", "salario",
)
ASSIGNED = [("com", 30, 1.5), ("adm", 10, 1.0)]
ADJUSTED = [(30, 1.0, 0.0), (10, 2.0, 10.0), (20, 5.0, 0.0), (40, 1.0, 55.5)]


def test_payroll(spark, boosted):
    rows = payroll_rows(
        spark, boosted, inputs(spark, bonus_assignment=ASSIGNED, adjustments=ADJUSTED)
    )
    assert set(rows) == set(WANT)
    for name, want in WANT.items():
        assert tuple(rows[name][c] for c in SHOWN) == pytest.approx(want, abs=1e-9)


def test_entries_of_another_period_do_not_apply(spark, boosted):
    """With a period, entries count in that period; people without any get the defaults."""
    entered = inputs(spark)
    entered._loaded["bonus_assignment"] = spark.createDataFrame(
        [(PERIOD, "com", 30, 1.5), (PERIOD + 1, "com", 20, 1.0)],
        "period int, category string, id_usuario bigint, weight double",
    )
    entered._loaded["adjustments"] = spark.createDataFrame(
        [(PERIOD, 10, 2.0, 10.0), (PERIOD + 1, 20, 5.0, 99.0)],
        "period int, id_usuario bigint, attitude double, overtime double",
    )
    rows = payroll_rows(spark, boosted, entered)
    assert rows["Ana"].grat_comite == 918.75
    assert rows["Caio"].grat_comite == 0.0
    assert rows["Bia"].horas_extras == 10.0
    assert rows["Caio"].horas_extras == 0.0
    assert rows["Caio"].produtividade == pytest.approx(13.7 * 1.01, abs=1e-9)
