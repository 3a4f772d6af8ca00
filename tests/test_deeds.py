import datetime as dt

import pytest
from small import DAY, NEXT_MONTH, collect, fee, tables

from quinhao import rules as R
from quinhao.operators import deeds
from quinhao.plans.production import all_deed_acts

LAV, CONF = "Lavrado em cartorio", "Conferido"


def run(spark, period=None, **rows):
    return collect(
        all_deed_acts(tables(spark, **rows), period),
        "period", "sector", "stage", "id_usuario", "acts", "fees",
    )


def reception(number, *, paid="Liquidado", notes=((7, LAV, "False"),), books=((270, DAY, 1),)):
    """One reception with one movement of a single item worth ten."""
    return {
        "movimento_caixa": [(number, number, DAY, paid)],
        "item_movimento_caixa": [(number, 1, fee(10), None)],
        "recepcao_anotacoes": [(number, user, text, out) for user, text, out in notes],
        "livros_notas": [(number, day, act, book) for act, day, book in books],
    }


def merge(*parts):
    names = {n for p in parts for n in p}
    return {n: [row for p in parts for row in p.get(n, [])] for n in names}


COUNTED = (202103, "esc", "lav", 7, 1.0, fee("10.00"))


def test_plain_reception_counts(spark):
    assert run(spark, **reception(1)) == [COUNTED]


@pytest.mark.parametrize(
    "change",
    [
        {"paid": "Pendente"},
        {"notes": ((7, LAV, "True"),)},  # annotation removed
        {"notes": ((7, "lavrado", "False"),)},  # prefixes are case-sensitive
        {"notes": ((7, LAV, "False"), (8, LAV, "False"))},  # two annotators
        {"notes": ((7, LAV, "False"), (7, LAV, "False"))},  # noted twice
        {"books": ((270, DAY, None),)},  # book not opened
        {"books": ((999, DAY, 1),)},  # act in no sector
        {"books": ((270, DAY, 1), (999, DAY, 2))},  # ambiguous whatever the act
        {"books": ((270, None, 1),)},
        {"books": ()},
    ],
)
def test_not_counted(spark, change):
    assert run(spark, **reception(1, **change)) == []


def test_stages_are_told_apart(spark):
    notes = ((7, LAV, "False"), (8, CONF, "False"))
    assert run(spark, **reception(1, notes=notes)) == [
        (202103, "esc", "conf", 8, 1.0, fee("10.00")), COUNTED,
    ]


def test_sectors_paid_for_one_stage_only(spark):
    """Powers of attorney are not paid for checking."""
    notes = ((7, LAV, "False"), (8, CONF, "False"))
    rows = run(spark, **reception(1, notes=notes, books=((58, DAY, 1),)))
    assert rows == [(202103, "proc", "lav", 7, 1.0, fee("10.00"))]


def test_books_in_two_months_count_in_each(spark):
    rows = run(spark, **reception(1, books=((270, DAY, 1), (94, NEXT_MONTH, 2))))
    assert rows == [COUNTED, (202104, "esc", "lav", 7, 1.0, fee("10.00"))]


def test_movements_of_one_reception_are_one_act(spark):
    """Also with movements of another month, and an unsettled one left out."""
    extra = {
        "movimento_caixa": [(50, 1, NEXT_MONTH, "Liquidado"), (51, 1, DAY, "Pendente")],
        "item_movimento_caixa": [
            (50, 1, fee("2.50"), None), (50, 1, fee("0.01"), 9), (51, 1, fee(100), None),
        ],
    }
    assert run(spark, **merge(reception(1), extra)) == [(*COUNTED[:5], fee("12.51"))]


def test_one_month_is_that_slice_of_all_months(spark):
    data = merge(
        reception(1),
        reception(2, books=((270, NEXT_MONTH, 1),)),
        reception(3, books=((58, dt.datetime(2021, 4, 30, 23, 59, 59), 1),)),
        reception(4, books=((270, DAY, 1), (270, DAY, 2))),
    )
    every = run(spark, **data)
    for period in (202103, 202104):
        assert run(spark, period, **data) == [r for r in every if r[0] == period]


def test_pairs_and_lists(spark):
    notes = ((7, LAV, "False"), (8, LAV, "False"), (9, LAV, "False"))
    books = ((270, DAY, 1), (94, DAY, 2))
    data = merge(reception(1), *[reception(n, notes=notes, books=books) for n in (2, 5, 1500)])
    t = tables(spark, **data)
    pairs = deeds.stage_pairs(t.recepcao_anotacoes, t.livros_notas)
    assert collect(pairs)[:2] == [
        (202103, "lav", 1, 1, 1, 7, 270), (202103, "lav", 1500, 3, 2, None, None),
    ]
    found = collect(deeds.ambiguous_receptions(pairs), "id_recepcao", "quantidade")
    assert sorted(found) == [(2, 6), (5, 6), (1500, 6)]
    lists = collect(deeds.ambiguous_list(pairs), "block", "receptions")
    assert lists == [(0, "2,5"), (1, "1500")]
    none = deeds.ambiguous_list(pairs.where("id_recepcao = 1"))
    assert collect(none, "receptions") == [("0",)]


def test_user_may_be_unknown(spark):
    rows = run(spark, **reception(1, notes=((None, LAV, "False"),)))
    assert rows == [(202103, "esc", "lav", None, 1.0, fee("10.00"))]


def test_code_lists():
    sizes = {s: len(c) for s, c in R.ACT_CODES.items()}
    assert sizes == {"esc": 61, "inv": 23, "proc": 33, "dec": 32}
    codes = [c for codes in R.ACT_CODES.values() for c in codes]
    assert len(codes) == len(set(codes))
