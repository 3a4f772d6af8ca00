"""Tables laid out by month, so that a month's payroll reads that month.

Every large table is partitioned by a month, also those that have no date of their own:

- movements by the month they were made in, books by the month they were registered in;
- items by the month of their movement, receipts and their items by the month of archiving;
- receptions and annotations by the *home* of the reception: its first month with a movement, else
  its first month with a book.

Rows of no month are in partition 0. Movements also carry their reception's home, and books carry it
with the months of the reception's movements. So the rows of one month name the partitions of all
that belongs to them: a reception from years ago that is booked this month adds the partitions it
lies in, and no range between them. What is named are months of the calendar, which are broadcast,
and the scans of the other tables prune their partitions by them when the query runs.

Ids of movements, receipts and receptions are taken to be unique in their own tables.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quinhao.functions.periods import period_of
from quinhao.operators.lookup import lookup_join
from quinhao.schemas import SCHEMAS, Tables
from quinhao.session import stored

NO_MONTH = 0
MONTHLY = (
    "movimento_caixa",
    "livros_notas",
    "item_movimento_caixa",
    "recibo",
    "item_recibo",
    "recepcao_titulo",
    "recepcao_anotacoes",
)


# What leads from a table's rows to the partitions of others.
LEADS = {"movimento_caixa": "home int", "livros_notas": "home int, movement_periods array<int>"}


def _month(date: Column) -> Column:
    return F.coalesce(period_of(date), F.lit(NO_MONTH))


def _placed(facts: DataFrame, places: DataFrame, key: str, column: str = "period") -> DataFrame:
    """``facts`` with the month of their key; a key that holds much of them is spread."""
    facts = facts.withColumn("_row", F.monotonically_increasing_id())
    found = lookup_join(facts, places, key, "left", by=["_row"]).drop("_row")
    return found.withColumn(column, F.coalesce(column, F.lit(NO_MONTH)))


def _moved(t: Tables) -> DataFrame:
    return t.movimento_caixa.withColumn("period", _month(F.col("data")))


def _booked(t: Tables) -> DataFrame:
    return t.livros_notas.withColumn("period", _month(F.col("data_reg")))


def receptions_of(t: Tables) -> DataFrame:
    """(id_recepcao, home, movement_periods) of the receptions with a movement or a book."""
    moved, booked = _moved(t), _booked(t)
    dated = F.when(F.col("period") != NO_MONTH, F.col("period"))
    seen = moved.select("id_recepcao", dated.alias("moved"), F.lit(None).cast("int").alias("book"))
    noted = booked.select("id_recepcao", F.lit(None).cast("int").alias("moved"), dated.alias("book"))
    return (
        seen.union(noted)
        .groupBy("id_recepcao")
        .agg(
            F.coalesce(F.min("moved"), F.min("book"), F.lit(NO_MONTH)).alias("home"),
            # calendar months, so a short list however many the movements
            F.collect_set("moved").alias("movement_periods"),
            F.max((F.col("moved").isNull() & F.col("book").isNull())).alias("undated"),
        )
        .withColumn(
            "movement_periods",
            F.when(F.col("undated"), F.array_append("movement_periods", F.lit(NO_MONTH)))
            .otherwise(F.col("movement_periods")),
        )
        .drop("undated")
    )


def laid_out(t: Tables, receptions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables with ``period``, and what leads from one to the partitions of another.

    Four of them need ``receptions_of``, which may be given as a stored table.
    """
    moved, booked = _moved(t), _booked(t)
    archived = F.when(F.col("arquivado") == "True", F.col("data_arquivado"))
    receipts = t.recibo.withColumn("period", _month(archived))
    if receptions is None:
        receptions = receptions_of(t)
    home = receptions.select("id_recepcao", F.col("home").alias("period"))
    return {
        "movimento_caixa": _placed(
            moved, receptions.select("id_recepcao", "home"), "id_recepcao", "home"
        ),
        "livros_notas": _placed(booked, receptions, "id_recepcao", "home"),
        "item_movimento_caixa": _placed(
            t.item_movimento_caixa, moved.select("id_mov_caixa", "period"), "id_mov_caixa"
        ),
        "recibo": receipts,
        "item_recibo": _placed(
            t.item_recibo, receipts.select("id_recibo", "period"), "id_recibo"
        ),
        "recepcao_titulo": _placed(t.recepcao_titulo, home, "id_recepcao"),
        "recepcao_anotacoes": _placed(t.recepcao_anotacoes, home, "id_recepcao"),
    }


WRITERS = 3  # tables written at a time, so that the last tasks of one leave no core idle


def write_layout(t: Tables, root: str) -> None:
    """Write all tables under ``root``; months that are too large for a task are split in files.

    What places the receptions is worked out once, into a table that is removed afterwards.
    """

    def write(name: str) -> None:
        if name in monthly:
            parts = monthly[name].hint("rebalance", F.col("period"))
            parts.write.mode("overwrite").partitionBy("period").parquet(f"{root}/{name}")
        else:
            whole[name].write.mode("overwrite").parquet(f"{root}/{name}")

    with stored(receptions_of(t), "receptions") as receptions:
        monthly, whole = laid_out(t, receptions), dict(t.items())
        with ThreadPoolExecutor(WRITERS) as writers:
            list(writers.map(write, whole))  # an error of any is raised here


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """By its known schema, as to infer one would start a job for each table."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
    more = (LEADS.get(name, ""), "period int" if name in MONTHLY else "")
    wanted = ", ".join([columns, *filter(None, more)])
    return spark.read.schema(wanted).parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str) -> Tables:
    """All rows of a layout, in the tables' own shape."""
    return Tables(lambda name: _read(spark, root, name).select(SCHEMAS[name].names))


def load_month(
    spark: SparkSession, root: str, period: int, as_of: dt.date | None = None
) -> Tables:
    """What the payroll of ``period`` needs, with receipts of the month of ``as_of``.

    Other rows of the partitions it lies in come along; the operators leave them out.
    """
    day = as_of or dt.date.today()
    movements = _read(spark, root, "movimento_caixa")
    books = _read(spark, root, "livros_notas").where(F.col("period") == period)
    made = movements.where(F.col("period") == period)
    months = books.select(F.explode("movement_periods").alias("period")).union(
        made.select("period")
    )
    homes = books.select("home").union(made.select("home")).toDF("period")
    named = {
        "movimento_caixa": months,
        "item_movimento_caixa": months,
        "recepcao_titulo": homes,
        "recepcao_anotacoes": homes,
    }

    def load(name: str) -> DataFrame:
        rows = movements if name == "movimento_caixa" else _read(spark, root, name)
        if name in named:  # months of the calendar
            rows = rows.join(F.broadcast(named[name].distinct()), "period", "left_semi")
        elif name == "livros_notas":
            rows = books
        elif name in MONTHLY:
            rows = rows.where(F.col("period") == day.year * 100 + day.month)
        return rows.select(SCHEMAS[name].names)

    return Tables(load, pruned=True)
