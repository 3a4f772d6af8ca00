"""Tiny hand-made tables."""

import datetime as dt
from decimal import Decimal

from quinhao.schemas import INPUT_SCHEMAS, SCHEMAS, Inputs, Tables

DAY = dt.datetime(2021, 3, 10)
NEXT_MONTH = dt.datetime(2021, 4, 1)


def fee(value) -> Decimal:
    return Decimal(str(value))


def tables(spark, **rows) -> Tables:
    """Tables with the given rows; the others are empty."""
    return Tables(lambda name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]))


def inputs(spark, **rows) -> Inputs:
    return Inputs(lambda name: spark.createDataFrame(rows.get(name, []), INPUT_SCHEMAS[name]))


def collect(df, *columns):
    """Rows as sorted tuples, of the given columns or all."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
