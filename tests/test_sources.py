import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from small import DAY, collect, fee, tables
from test_scale import brute_force, skewed

from quinhao import rules as R
from quinhao.plans import production as P
from quinhao.plans.export import payroll_export
from quinhao.plans.payroll import payroll
from quinhao.schemas import INPUT_SCHEMAS, SCHEMAS, Tables, conform
from quinhao.session import shared_folder
from quinhao.sources import files, jdbc, star

ROWS = {
    "funcionarios": [(1, "Ana", "CLT", None), (2, "Caio", "PJ", dt.date(2020, 1, 2))],
    "item_movimento_caixa": [(1, 2, fee("10.10"), None), (1, 3, fee("0.05"), 101)],
    "movimento_caixa": [(1, 10, DAY, "Liquidado")],
}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files_keep_the_schema(spark, tmp_path, fmt):
    source = tables(spark, **ROWS)
    for name, df in source.items():
        df.write.format(fmt).option("header", True).save(f"{tmp_path}/{name}")
    loaded = files.load_tables(spark, str(tmp_path), fmt)
    for name, df in loaded.items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in SCHEMAS[name]
        ]
    for name in ROWS:
        assert collect(getattr(loaded, name)) == collect(getattr(source, name))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_a_missing_column_is_an_error(spark, tmp_path, fmt):
    people = tables(spark, **ROWS).funcionarios.drop("data_saida")
    people.write.format(fmt).option("header", True).save(f"{tmp_path}/funcionarios")
    with pytest.raises(ValueError, match="funcionarios lacks columns .*data_saida"):
        files.load_tables(spark, str(tmp_path), fmt).funcionarios.collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_entries_of_a_month_are_paid_in_that_month(spark, tmp_path, fmt):
    """Adjustments and assignments for two months, through the loader: nobody is paid twice."""
    entries = {
        "adjustments": ("id_usuario bigint, attitude double, overtime double, period int",
                        [(10, 2.0, 10.0, 202103), (10, 3.0, 20.0, 202104)]),
        "bonus_assignment": ("period int, category string, id_usuario bigint, weight double",
                             [(202103, "ger", 10, 1.0), (202104, "ger", 10, 2.0)]),
    }
    for name, (kind, rows) in entries.items():
        df = spark.createDataFrame(rows, kind)
        df.write.format(fmt).option("header", True).save(f"{tmp_path}/{name}")
    entered = files.load_inputs(spark, str(tmp_path), fmt)
    assert entered.adjustments.columns == ["period", "id_usuario", "attitude", "overtime"]
    t = tables(
        spark, funcionarios=[(1, "Ana", "CLT", None)], usuario=[(10, 1, "False", "False")]
    )
    for period, overtime, allowance in ((202103, 10.0, 1041.25), (202104, 20.0, 2082.5)):
        rows = payroll(t, entered, period=period, values={"adm": 0.0})
        assert collect(rows, "id_usuario", "horas_extras", "funcao_gerencia") == [
            (10, overtime, allowance)
        ]


def test_star_views_have_the_schema(spark):
    root = "/root/testdata/sf0.001"
    for loaded, wanted in (
        (star.load_tables(spark, root), SCHEMAS),
        (star.load_inputs(spark, root), INPUT_SCHEMAS),
    ):
        for name, df in loaded.items():
            assert [(f.name, f.dataType) for f in df.schema] == [
                (f.name, f.dataType) for f in wanted[name]
            ]


def test_conform_matches_any_case_and_reports_what_is_missing(spark):
    df = spark.sql("SELECT 1 AS ID_RECIBO, 'x' AS extra, 2.5D AS Taxa_1")
    assert collect(conform(df, SCHEMAS["item_recibo"], "item_recibo")) == [(1, fee("2.50"))]
    with pytest.raises(ValueError, match="item_recibo lacks columns .*taxa_1"):
        conform(df.drop("Taxa_1"), SCHEMAS["item_recibo"], "item_recibo")


def test_unknown_table(spark):
    with pytest.raises(AttributeError):
        tables(spark).nothing


@pytest.fixture(scope="module")
def office():
    """The tables in an embedded database, which runs the queries that the reader would send."""
    db = duckdb.connect()
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "decimal(18,2)": "DECIMAL(18,2)"}
    for name, schema in SCHEMAS.items():
        columns = ", ".join(f"{f.name} {kinds[f.dataType.simpleString()]}" for f in schema.fields)
        db.execute(f"CREATE TABLE {jdbc.database_name(name)} ({columns})")
        rows = skewed(seed=21).get(name, [])
        if rows:
            marks = ", ".join("?" * len(schema.fields))
            db.executemany(f"INSERT INTO {jdbc.database_name(name)} VALUES ({marks})", rows)
    day = "TIMESTAMP '2021-03-10'"
    db.execute(f"INSERT INTO RECIBO SELECT i, 'True', {day} + INTERVAL (i % 3) MONTH FROM range(30) t(i)")
    db.execute("INSERT INTO ITEM_RECIBO SELECT i % 30, i FROM range(200) t(i)")
    db.execute("INSERT INTO ITEM_RECIBO VALUES (NULL, 5)")
    return db


@pytest.mark.parametrize("period", [None, 202103])
@pytest.mark.parametrize("table", sorted(jdbc.SLICE_KEYS))
def test_slices_hold_every_row_once_and_alike(office, table, period):
    source = jdbc.source_query(table, period)
    cuts = [r[0] for r in office.execute(jdbc.cuts_query(table, source, 7)).fetchall()]
    parts = [
        office.execute(f"SELECT * FROM {source} WHERE {p}").fetchall()
        for p in jdbc.predicates(table, cuts)
    ]
    whole = office.execute(f"SELECT * FROM {source}").fetchall()
    assert Counter(r for p in parts for r in p) == Counter(whole) and len(whole) > 0
    assert len(parts) > 1 and all(parts)  # gaps in the keys leave no slice empty


def test_slices_without_keys():
    assert jdbc.predicates("recibo", []) == ["1 = 1"]
    assert jdbc.predicates("recibo", [4]) == ["1 = 1"]
    assert jdbc.predicates("recibo", [9, 4]) == ["ID_RECIBO < 9 OR ID_RECIBO IS NULL", "ID_RECIBO >= 9"]


@pytest.mark.parametrize("period", [202103, 202104])
def test_rows_of_a_month_are_all_its_payroll_needs(spark, office, period):
    """The month's queries, run by the embedded database, against brute force over everything."""

    def load(name):
        found = office.execute(f"SELECT * FROM {jdbc.source_query(name, period)}").fetchall()
        return spark.createDataFrame(found, SCHEMAS[name])

    got = collect(
        P.all_acts(Tables(load, pruned=True), period),
        "period", "sector", "stage", "id_usuario", "acts", "fees",
    )
    assert sorted(got) == [r for r in brute_force(skewed(seed=21)) if r[0] == period]


def test_receipts_go_by_their_own_month(office):
    source = jdbc.source_query("item_recibo", 202103, dt.date(2021, 4, 30))
    days = office.execute(
        f"SELECT DISTINCT month(DATA_ARQUIVADO) FROM {source} JOIN RECIBO USING (ID_RECIBO)"
    )
    assert days.fetchall() == [(4,)]
    assert jdbc.source_query("usuario", 202103) == '"TBL$USUARIO"'
    assert set(jdbc.SLICE_KEYS) == set(jdbc.MONTH_OF) <= set(SCHEMAS)


def export_folders(spark):
    root = Path(shared_folder(spark)) / "quinhao"
    return sorted(p.name for p in root.glob("*")) if root.exists() else []


def test_export(spark, tmp_path):
    kind = "period int, nome_funcionario string, salario double"
    march = spark.createDataFrame([(202103, "Ana", 10.129), (202103, "Bia", 0.125)], kind)
    april = spark.createDataFrame([(202104, "Ana", 2.0)], kind)
    before = export_folders(spark)
    payroll_export(march, str(tmp_path / "out"))
    payroll_export(april, str(tmp_path / "out"))  # leaves March alone
    payroll_export(march, str(tmp_path / "out"))  # a second run replaces the first
    assert export_folders(spark) == before  # and leaves nothing behind
    back = spark.read.parquet(f"{tmp_path}/out/parquet")
    assert collect(back, *march.columns) == collect(march.union(april))
    for side in ("parquet", "csv"):
        assert sorted(p.name for p in (tmp_path / "out" / side).glob("period=*")) == [
            "period=202103", "period=202104",
        ]
    text = spark.read.csv(f"{tmp_path}/out/csv", header=True)
    assert collect(text, "nome_funcionario", "salario", "period") == [
        ("Ana", "10.13", 202103), ("Ana", "2.00", 202104), ("Bia", "0.12", 202103),
    ]


def test_a_payroll_that_is_not_used_leaves_no_table(spark):
    before = export_folders(spark)
    loaded = star.load_tables(spark, "/root/testdata/sf0.001")
    payroll(loaded, star.load_inputs(spark, "/root/testdata/sf0.001"))
    assert export_folders(spark) == before


def test_rule_tables_are_literals(spark):
    """Literal tables fold into the plan; they are not parallelized Python lists."""
    for df in (R.sector_rules(spark), R.sector_groups(spark), R.sector_acts(spark)):
        assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
