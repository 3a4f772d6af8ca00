"""A period is a calendar month written as an int: year * 100 + month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quinhao.rules import MONTH_NAMES


def period_of(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def bounds(period: int) -> tuple[dt.date, dt.date]:
    """First day of the month and first day of the next one."""
    year, month = divmod(period, 100)
    if not 1 <= month <= 12:
        raise ValueError(f"not a period: {period}")
    return dt.date(year, month, 1), dt.date(year + month // 12, month % 12 + 1, 1)


def in_period(date: Column, period: int | None) -> Column:
    """Half-open range, so that the scan can skip row groups; None keeps every dated row."""
    if period is None:
        return date.isNotNull()
    start, end = bounds(period)
    return (date >= F.lit(start)) & (date < F.lit(end))


def in_month_of(date: Column, as_of: dt.date | None) -> Column:
    """Rows dated in the month of ``as_of``; None means the month of today."""
    if as_of is not None:
        return in_period(date, as_of.year * 100 + as_of.month)
    start = F.trunc(F.current_date(), "month")
    return (date >= start) & (date < F.add_months(start, 1))


def month_name(period: Column) -> Column:
    """Name of the period's month."""
    names = F.create_map(
        *[F.lit(x) for i, name in enumerate(MONTH_NAMES, start=1) for x in (i, name)]
    )
    return F.element_at(names, period % 100)
