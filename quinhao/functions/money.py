"""Money arithmetic: exact decimals for sums, doubles for shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quinhao.rules import DEDUCTION

MONEY = "decimal(28,2)"


def money_sum(column: str) -> Column:
    """Exact sum of a money column, the same in any order of rows."""
    return F.sum(column).cast(MONEY)


def net(amount: Column) -> Column:
    """What is left of a gross amount after the deduction (exact decimal)."""
    return amount - amount * F.lit(DEDUCTION).cast("decimal(4,3)")


def half_even(value: Column, digits: int = 2) -> Column:
    """Round a double half to even on its binary value, as numeric libraries do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))
