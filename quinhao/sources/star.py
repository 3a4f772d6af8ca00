"""The operational tables and inputs as views over a star schema of orders.

Suppliers stand for employees, orders for receptions, line items for fee items and annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quinhao.schemas import COUNT, ID, MOMENT, NUMBER, TEXT, Inputs, Tables, schema

# Columns of the star schema that the views use.
STAR_SCHEMAS: dict[str, StructType] = {
    "supplier": schema(s_suppkey=ID, s_name=TEXT, s_nationkey=COUNT, s_acctbal=NUMBER),
    "part": schema(p_partkey=ID, p_size=COUNT),
    "orders": schema(
        o_orderkey=ID, o_custkey=ID, o_orderstatus=TEXT, o_orderdate=MOMENT, o_orderpriority=TEXT
    ),
    "lineitem": schema(
        l_orderkey=ID, l_partkey=ID, l_suppkey=ID, l_quantity=NUMBER, l_extendedprice=NUMBER,
        l_returnflag=TEXT, l_linestatus=TEXT,
    ),
}

# Fixed values of the binding: part sizes that stand for a fee-group code other than their own,
# and the act code of a book by customer number (999 is in no sector).
CODE = "CASE p_size WHEN 50 THEN 63 WHEN 49 THEN 62 WHEN 48 THEN 55 ELSE p_size END"
ACT = (
    "CASE o_custkey % 10 WHEN 0 THEN 270 WHEN 1 THEN 94 WHEN 2 THEN 309 WHEN 3 THEN 344"
    " WHEN 4 THEN 58 WHEN 5 THEN 7 WHEN 6 THEN 242 WHEN 7 THEN 57 ELSE 999 END"
)
FEE = "CAST(l_extendedprice AS DECIMAL(18,2)) AS taxa_1"

# View -> (star table, expressions).
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "funcionarios": ("supplier", (
        "s_suppkey AS id_funcionario",
        "s_name AS nome_funcionario",
        "IF(s_nationkey % 5 = 0, 'PJ', 'CLT') AS identificador_regime_trab",
        "IF(s_acctbal < 0, DATE'1999-01-01', NULL) AS data_saida",
    )),
    "usuario": ("supplier", (
        "s_suppkey AS id_usuario",
        "s_suppkey AS id_profissional",
        "IF(s_suppkey % 10 = 9, 'True', 'False') AS bloqueado",
        "IF(s_nationkey % 2 = 0, 'True', 'False') AS permissao_assinar",
    )),
    "recibo": ("orders", (
        "o_orderkey AS id_recibo",
        "IF(o_orderstatus = 'F', 'True', 'False') AS arquivado",
        "o_orderdate AS data_arquivado",
    )),
    "item_recibo": ("lineitem", ("l_orderkey AS id_recibo", FEE)),
    "movimento_caixa": ("orders", (
        "o_orderkey AS id_mov_caixa",
        "o_orderkey AS id_recepcao",
        "o_orderdate AS data",
        "IF(o_orderstatus = 'P', 'Pendente', 'Liquidado') AS situacao_pgto",
    )),
    "item_movimento_caixa": ("lineitem", (
        "l_orderkey AS id_mov_caixa",
        "CAST(l_quantity AS INT) AS qtde_ato",
        FEE,
        "l_partkey AS id_transacao",
    )),
    "transacao_ato": ("part", ("p_partkey AS id_transacao", f"{CODE} AS esat_grat_codigo")),
    "grupo_ato": ("part", (f"{CODE} AS codigo",)),
    "recepcao_titulo": ("lineitem", ("l_orderkey AS id_recepcao", "l_suppkey AS id_usuario")),
    "recepcao_anotacoes": ("lineitem", (
        "l_orderkey AS id_recepcao",
        "l_suppkey AS id_usuario",
        "CASE l_returnflag WHEN 'A' THEN 'Lavrado em cartorio' WHEN 'R' THEN 'Conferido'"
        " ELSE 'Outro' END AS anotacao",
        "IF(l_linestatus = 'F', 'False', 'True') AS excluido",
    )),
    "livros_notas": ("orders", (
        "o_orderkey AS id_recepcao",
        "o_orderdate AS data_reg",
        f"{ACT} AS ato",
        "IF(o_orderpriority = '5-LOW', NULL, o_orderkey) AS id_livro_inicio",
    )),
    "adjustments": ("supplier", (
        "s_suppkey AS id_usuario",
        "CAST(1 + s_suppkey % 5 AS DOUBLE) AS attitude",
        "CAST((s_suppkey % 3) * 12.5 AS DOUBLE) AS overtime",
    )),
    # Each category goes to every so many supplier numbers.
    "bonus_assignment": ("supplier", (
        "EXPLODE(MAP_KEYS(MAP_FILTER("
        "MAP('adm', 11, 'esc', 7, 'proc', 5, 'ger', 13, 'com', 6, 'tap', 3, 'fam', 2),"
        " (category, every) -> s_suppkey % every = 0))) AS category",
        "s_suppkey AS id_usuario",
        "CAST(1 + (s_suppkey % 4) * 0.5 AS DOUBLE) AS weight",
    )),
    # Entries of two months, and entries with every kind of fault.
    "monthly_adjustments": ("supplier", (
        "EXPLODE(ARRAY(199603, 199604)) AS period",
        "s_suppkey AS id_usuario",
        "CAST(1 + s_suppkey % 5 AS DOUBLE) AS attitude",
        "CAST((s_suppkey % 3) * 12.5 AS DOUBLE) AS overtime",
    )),
    "monthly_bonus_assignment": ("supplier", (
        "IF(s_suppkey % 2 = 0, 199603, 199604) AS period",
        "IF(s_suppkey % 3 = 0, 'esc', 'fam') AS category",
        "s_suppkey AS id_usuario",
        "CAST(1 + (s_suppkey % 4) * 0.5 AS DOUBLE) AS weight",
    )),
    "faulty_adjustments": ("supplier", (
        "EXPLODE(SEQUENCE(1, IF(s_suppkey % 15 = 0, 2, 1))) AS entry",
        "CASE s_suppkey % 9 WHEN 0 THEN 201912 WHEN 1 THEN 203101 ELSE 202103 END AS period",
        "s_suppkey AS id_usuario",
        "CASE s_suppkey % 7 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN 6.0D ELSE 2.0D END"
        " AS attitude",
        "CAST(IF(s_suppkey % 8 = 0, -1.0, 5.0) AS DOUBLE) AS overtime",
    )),
    "faulty_bonus_assignment": ("supplier", (
        "EXPLODE(SEQUENCE(1, IF(s_suppkey % 20 = 0, 3, 1))) AS entry",
        "CASE s_suppkey % 6 WHEN 0 THEN 'bonus' WHEN 1 THEN NULL ELSE 'esc' END AS category",
        "s_suppkey AS id_usuario",
        "CASE s_suppkey % 5 WHEN 0 THEN 0.5D WHEN 1 THEN CAST(NULL AS DOUBLE) ELSE 1.0D END"
        " AS weight",
    )),
}


def _view(spark: SparkSession, root: str, name: str) -> DataFrame:
    source, expressions = VIEWS[name]
    rows = spark.read.schema(STAR_SCHEMAS[source]).parquet(f"{root}/{source}.parquet")
    if name == "adjustments":  # the others get the defaults
        rows = rows.where("s_suppkey % 4 <> 3")
    view = rows.selectExpr(*expressions)
    if name == "grupo_ato":
        return view.distinct()
    if name == "recepcao_titulo":
        return view.groupBy("id_recepcao").agg(F.min("id_usuario").alias("id_usuario"))
    return view


def load_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(lambda name: _view(spark, root, name))


def load_inputs(spark: SparkSession, root: str) -> Inputs:
    return Inputs(lambda name: _view(spark, root, name))


def load_entries(spark: SparkSession, root: str, kind: str) -> Inputs:
    """Other inputs over the same people: ``monthly`` or ``faulty`` ones."""
    return Inputs(lambda name: _view(spark, root, f"{kind}_{name}").drop("entry"))
