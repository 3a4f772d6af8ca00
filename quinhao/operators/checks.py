"""Checks on what was entered by hand: what a form would not have let through."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quinhao.rules import BONUS_COLUMNS, INPUT_RANGES

# How a row of each input table is named in the report; with its period first, if it has one.
ROW_KEYS: dict[str, tuple[str, ...]] = {
    "sector_rules": ("sector", "stage"),
    "payroll_params": (),
    "bonus_rates": ("category",),
    "bonus_assignment": ("category", "id_usuario"),
    "adjustments": ("id_usuario",),
}


def _key_columns(name: str, df: DataFrame) -> list[str]:
    return [*(["period"] if "period" in df.columns else []), *ROW_KEYS[name]]


def _row_key(columns: list[str]) -> Column:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]
    return F.concat_ws("/", *texts).alias("key")


def input_violations(
    tables: Mapping[str, DataFrame],
    ranges: Mapping[tuple[str, str], tuple[float, float]] = INPUT_RANGES,
    roster: DataFrame | None = None,
    categories: Collection[str] = tuple(BONUS_COLUMNS),
) -> DataFrame:
    """Entries to be put right: table, row key, problem, column, value and the range.

    Problems are ``range`` (the value is outside it), ``missing`` (there is none), ``unknown``
    (no such category), ``repeated`` (the key has several entries; ``value`` is how many) and,
    with a roster, ``off roster`` (the person is not on it).
    """
    found = []
    for name in dict.fromkeys(table for table, _ in ranges if table in tables):
        df = tables[name]
        if "period" in df.columns:
            df = df.withColumn("year", F.expr("period DIV 100"))
        keys = _key_columns(name, df)
        limits = {
            column: (float(low), float(high))
            for (table, column), (low, high) in ranges.items()
            if table == name and column in df.columns
        }
        found.append(_out_of_range(df, name, keys, limits))
        if "category" in keys and name == "bonus_assignment":
            unknown = ~F.coalesce(F.col("category").isin(*categories), F.lit(False))
            found.append(_flagged(df.where(unknown), name, keys, "unknown", "category"))
        if "id_usuario" in keys:
            found.append(_repeated(df, name, keys))
            if roster is not None:
                people = roster.select("id_usuario")
                off = df.join(people, "id_usuario", "left_anti")
                found.append(_flagged(off, name, keys, "off roster", "id_usuario"))
    return reduce(DataFrame.unionByName, found)


def _out_of_range(
    df: DataFrame, name: str, keys: list[str], limits: Mapping[str, tuple[float, float]]
) -> DataFrame:
    checks = [
        F.struct(
            F.when(F.col(column).isNull(), "missing").otherwise("range").alias("problem"),
            F.lit(column).alias("column"),
            F.col(column).cast("double").alias("value"),
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
        )
        for column, (low, high) in limits.items()
    ]
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return df.select(
        F.lit(name).alias("table"), _row_key(keys), F.inline(F.array(*checks))
    ).where(~F.coalesce(inside, F.lit(False)))


def _flagged(
    df: DataFrame,
    name: str,
    keys: list[str],
    problem: str,
    column: str,
    value: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        F.lit(name).alias("table"),
        _row_key(keys),
        F.lit(problem).alias("problem"),
        F.lit(column).alias("column"),
        (none if value is None else value.cast("double")).alias("value"),
        none.alias("low"),
        none.alias("high"),
    )


def _repeated(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    return _flagged(counts, name, keys, "repeated", "entries", F.col("entries"))
