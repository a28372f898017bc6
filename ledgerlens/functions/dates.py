"""Date parsing and calendar expressions (all ``Column -> Column``).

Everything here is a built-in Catalyst expression, so it stays inside
whole-stage codegen; nothing calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import SALE_DATE_FORMAT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col, fmt: str = SALE_DATE_FORMAT) -> Column:
    """Text date in an explicit format; malformed or null text gives NULL.

    ANSI mode makes ``to_date`` raise on bad text, so the ``try_`` form is used.
    """
    return F.try_to_date(_c(col), fmt)


def format_date(col, fmt: str = SALE_DATE_FORMAT) -> Column:
    return F.date_format(_c(col), fmt)


def add_days(col, n: int = 1) -> Column:
    return F.date_add(_c(col), n)


def weekday(col) -> Column:
    """Day of week, 0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(col))


def weekday_name(col) -> Column:
    """English day name, Monday ... Sunday."""
    return F.date_format(_c(col), "EEEE")


def day_of_month(col) -> Column:
    return F.dayofmonth(_c(col))


def week_of_year(col) -> Column:
    """ISO-8601 week number; late-December days can fall in week 1."""
    return F.weekofyear(_c(col))


def month_of_year(col) -> Column:
    return F.month(_c(col))


def week_start_monday(col) -> Column:
    """The Monday on or before the date, as a DATE."""
    d = _c(col)
    return F.date_sub(d, F.weekday(d))


def relative_day(col, first) -> Column:
    """Whole days since ``first`` (a Column or a scalar-subquery Column)."""
    return F.datediff(_c(col), _c(first))


def relative_week(col, first) -> Column:
    """Weeks between the Monday of ``col`` and the Monday of ``first``."""
    days = F.datediff(week_start_monday(col), week_start_monday(first))
    return F.floor(days / F.lit(7)).cast("int")


def month_index(col, base_year: int) -> Column:
    """Running month counter from January of ``base_year`` (0-based)."""
    d = _c(col)
    return ((F.year(d) - F.lit(base_year)) * 12 + F.month(d) - 1).cast("int")


def with_calendar(df, date_col: str = "sale_date", first=None):
    """Add the calendar columns used by the sales breakdowns.

    ``first`` defaults to the minimum date of ``df`` as a scalar subquery, so
    week and day numbers count from the frame's own first date.
    """
    if first is None:
        first = df.select(F.min(date_col)).scalar()
    d = F.col(date_col)
    return df.select(
        "*",
        relative_week(d, first).alias("week_num"),
        relative_day(d, first).alias("day_num"),
        weekday(d).alias("day_of_the_week"),
        day_of_month(d).alias("day_of_the_month"),
        week_of_year(d).alias("week_of_the_year"),
        month_of_year(d).alias("month_of_the_year"),
    )
