import pytest
from small import DAY, NEXT_MONTH, collect, fee, tables

from quinhao import rules as R
from quinhao.operators import fees
from quinhao.plans.production import all_fee_acts

DATA = {
    "movimento_caixa": [
        (1, 10, DAY, "Liquidado"),
        (2, 10, DAY, "Pendente"),  # fee sectors also count what is not settled
        (3, 11, NEXT_MONTH, "Liquidado"),
        (4, 12, None, "Liquidado"),
        (5, 99, DAY, "Liquidado"),  # no such reception
    ],
    "item_movimento_caixa": [
        (1, 2, fee("10.10"), 100),
        (1, 3, fee("0.05"), 101),
        (2, 1, fee("5.00"), 100),
        (3, 4, fee("8.00"), 100),
        (4, 1, fee("1.00"), 100),
        (5, 1, fee("1.00"), 100),
        (1, 9, fee("90.00"), None),
        (1, 9, fee("91.00"), 102),  # group in no sector
        (1, 9, fee("92.00"), 103),  # group unknown to the group table
        (7, 9, fee("93.00"), 100),  # no such movement
    ],
    "recepcao_titulo": [(10, 7), (11, 7), (12, 7)],
    "transacao_ato": [(100, 3), (101, 63), (102, 4), (103, 8)],
    "grupo_ato": [(3,), (63,), (4,)],
}
WANT = [
    (202103, "apo", "fee", 7, 3.0, fee("0.05")),
    (202103, "aut", "fee", 7, 3.0, fee("15.10")),
    (202104, "aut", "fee", 7, 4.0, fee("8.00")),
]


def test_all_months(spark):
    assert collect(all_fee_acts(tables(spark, **DATA))) == WANT


@pytest.mark.parametrize("period", [202103, 202104, 202105])
def test_one_month(spark, period):
    got = collect(all_fee_acts(tables(spark, **DATA), period))
    assert got == [r for r in WANT if r[0] == period]


def operands(t):
    return (
        t.movimento_caixa, t.item_movimento_caixa, t.recepcao_titulo, t.transacao_ato, t.grupo_ato,
    )


@pytest.fixture(params=["-1", "10485760b"])
def broadcast_limit(spark, request):
    """With and without lookups that the engine can broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lookup_gives_the_same(spark, broadcast_limit):
    t = tables(spark, **DATA)
    acts = fees.fee_acts(*operands(t), R.sector_groups(spark))
    assert collect(acts) == WANT


def test_enriched_keeps_items_without_group(spark, broadcast_limit):
    t = tables(spark, **DATA)
    rows = collect(fees.movement_enriched(*operands(t)))
    assert rows == sorted(
        [
            (202103, 10, 7, 100, 3, 3, fee("15.10"), 2),
            (202103, 10, 7, 101, 63, 3, fee("0.05"), 1),
            (202103, 10, 7, 102, 4, 9, fee("91.00"), 1),
            (202103, 10, 7, 103, None, 9, fee("92.00"), 1),
            (202103, 10, 7, None, None, 9, fee("90.00"), 1),
            (202104, 11, 7, 100, 3, 4, fee("8.00"), 1),
        ],
        key=repr,
    )
