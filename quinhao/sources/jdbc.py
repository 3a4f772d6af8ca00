"""Tables read from the operational database over JDBC."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from quinhao.functions.periods import bounds
from quinhao.schemas import SCHEMAS, Tables, conform

# Table names in the operational database that differ from ours.
DATABASE_NAMES: dict[str, str] = {"usuario": '"TBL$USUARIO"'}

# Key by which a large table is read in slices.
SLICE_KEYS: dict[str, str] = {
    "recibo": "id_recibo",
    "item_recibo": "id_recibo",
    "movimento_caixa": "id_mov_caixa",
    "item_movimento_caixa": "id_mov_caixa",
    "recepcao_titulo": "id_recepcao",
    "recepcao_anotacoes": "id_recepcao",
    "livros_notas": "id_recepcao",
}


# How the rows of a large table belong to a month: by the date of a table they are joined with.
MONTH_OF: dict[str, str] = {
    "recibo": "T.ARQUIVADO = 'True' AND {within:T.DATA_ARQUIVADO}",
    "item_recibo": "T.ID_RECIBO IN (SELECT R.ID_RECIBO FROM {recibo} R"
    " WHERE R.ARQUIVADO = 'True' AND {within:R.DATA_ARQUIVADO})",
    "movimento_caixa": "{within:T.DATA} OR T.ID_RECEPCAO IN (SELECT B.ID_RECEPCAO"
    " FROM {livros_notas} B WHERE {within:B.DATA_REG})",
    "item_movimento_caixa": "T.ID_MOV_CAIXA IN (SELECT M.ID_MOV_CAIXA FROM {movimento_caixa} M"
    " WHERE {within:M.DATA} OR M.ID_RECEPCAO IN (SELECT B.ID_RECEPCAO FROM {livros_notas} B"
    " WHERE {within:B.DATA_REG}))",
    "recepcao_titulo": "T.ID_RECEPCAO IN (SELECT M.ID_RECEPCAO FROM {movimento_caixa} M"
    " WHERE {within:M.DATA})",
    "recepcao_anotacoes": "T.ID_RECEPCAO IN (SELECT B.ID_RECEPCAO FROM {livros_notas} B"
    " WHERE {within:B.DATA_REG})",
    "livros_notas": "{within:T.DATA_REG}",
}


def database_name(table: str) -> str:
    return DATABASE_NAMES.get(table, table.upper())


def source_query(table: str, period: int | None = None, as_of: dt.date | None = None) -> str:
    """What to read: the whole table, or the rows that the payroll of a month needs.

    The database filters by its own indexes, so other months don't cross the network. Receipts go by
    the month of ``as_of`` (default: that of the period).
    """
    name = database_name(table)
    if period is None or table not in MONTH_OF:
        return name
    month = period
    if table in ("recibo", "item_recibo") and as_of is not None:
        month = as_of.year * 100 + as_of.month
    start, end = (f"TIMESTAMP '{day:%Y-%m-%d} 00:00:00'" for day in bounds(month))
    where = re.sub(
        r"\{within:([A-Z_.]+)\}", rf"(\1 >= {start} AND \1 < {end})", MONTH_OF[table]
    )
    where = re.sub(r"\{([a-z_]+)\}", lambda m: database_name(m[1]), where)
    return f"(SELECT T.* FROM {name} T WHERE {where}) Q"


def cuts_query(table: str, source: str, count: int) -> str:
    """Query for the least key of each of ``count`` slices with as many rows each."""
    key = SLICE_KEYS[table].upper()
    return (
        f"SELECT MIN({key}) AS CUT FROM (SELECT {key}, NTILE({count}) OVER (ORDER BY {key}) AS PART"
        f" FROM {source} WHERE {key} IS NOT NULL) S GROUP BY PART"
    )


def predicates(table: str, cuts: Iterable[int]) -> list[str]:
    """Conditions that part a table at the cuts: every row, also without a key, meets just one.

    Gaps in the keys leave no slice empty, as the cuts are quantiles; a key with the rows of several
    slices is one.
    """
    key = SLICE_KEYS[table].upper()
    inner = sorted(set(cuts))[1:]
    if not inner:
        return ["1 = 1"]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(inner, inner[1:])]
    return [f"{key} < {inner[0]} OR {key} IS NULL", *between, f"{key} >= {inner[-1]}"]


def load_tables(
    spark: SparkSession,
    connection: Mapping[str, str],
    count: int | None = None,
    period: int | None = None,
    as_of: dt.date | None = None,
) -> Tables:
    """The eleven tables, or their rows for one month; ``connection`` has url, user, password, driver.

    Large tables are read in ``count`` slices (default: one for each core) of equal numbers of rows,
    which the database is asked for; the cuts are as many numbers as slices.
    """
    count = count or spark.sparkContext.defaultParallelism
    options = {"fetchsize": "10000", "preferTimestampNTZ": "true", **connection}
    properties = {k: v for k, v in options.items() if k != "url"}

    def load(name: str) -> DataFrame:
        source = source_query(name, period, as_of)
        if name not in SLICE_KEYS:
            reader = spark.read.format("jdbc").options(**options, dbtable=source)
            return conform(reader.load(), SCHEMAS[name], name)
        asked = spark.read.format("jdbc").options(**options, query=cuts_query(name, source, count))
        cuts = [int(row[0]) for row in asked.load().collect()]  # one for each slice
        parts = predicates(name, cuts)
        rows = spark.read.jdbc(connection["url"], source, predicates=parts, properties=properties)
        return conform(rows, SCHEMAS[name], name)

    return Tables(load, pruned=period is not None)
