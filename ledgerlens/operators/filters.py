"""Row filters of the sales model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import semi_join


def positive_sales(log: DataFrame, qty_col: str = "item_cnt_day") -> DataFrame:
    """drop returns and zero rows (pushed into the Parquet scan)."""
    return log.filter(F.col(qty_col) > 0)


def max_date(log: DataFrame, date_col: str = "sale_date",
             month_col: str | None = None) -> Column:
    """The latest date as a scalar subquery (computed once per query).

    With ``month_col`` (a month counter that grows with the date, e.g. the
    partition column of the sales table) only the newest month is scanned for
    the maximum date.
    """
    if month_col is None:
        return log.select(F.max(date_col)).scalar()
    newest = log.select(F.max(month_col)).scalar()
    return log.filter(F.col(month_col) == newest).select(F.max(date_col)).scalar()


def recent_months(log: DataFrame, month_col: str | None, months: int) -> DataFrame:
    """Restrict to the newest ``months`` month values (partition pruning)."""
    if month_col is None:
        return log
    newest = log.select(F.max(month_col)).scalar()
    return log.filter(F.col(month_col) > newest - F.lit(months))


def latest_day(log: DataFrame, date_col: str = "sale_date",
               month_col: str | None = None) -> DataFrame:
    """rows on the table's latest date."""
    last = max_date(log, date_col, month_col)
    return recent_months(log, month_col, 1).filter(F.col(date_col) == last)


def previous_day(log: DataFrame, date_col: str = "sale_date",
                 month_col: str | None = None) -> DataFrame:
    """rows whose date plus one day is the latest date (calendar day)."""
    last = max_date(log, date_col, month_col)
    return (recent_months(log, month_col, 2)
            .filter(F.date_add(F.col(date_col), 1) == last))


def in_top(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """rows whose ``key`` is among the rows of ``top`` (a semi-join)."""
    return semi_join(df, top.select(key), key)


def class_pair(df: DataFrame, abc: str, xyz: str) -> DataFrame:
    """one ABC class and one XYZ class."""
    return df.filter((F.col("abc") == abc) & (F.col("xyz") == xyz))


def share_band(df: DataFrame, low: float | None, high: float,
               share_col: str = "percentage") -> DataFrame:
    """rows with ``low < share <= high`` (``low=None``: no lower bound)."""
    cond = F.col(share_col) <= high
    if low is not None:
        cond = cond & (F.col(share_col) > low)
    return df.filter(cond)


def complete_periods(df: DataFrame, unit: str = "quarter", date_col: str = "sale_date") -> DataFrame:
    """Rows of calendar periods (``month``, ``quarter``, ``year``) that the
    data covers to their last day: a trailing period cut off by the latest
    date would understate its total and distort a variation measure.

    Keeps ``date < trunc(latest date + 1 day, unit)``; the latest date is a
    scalar subquery, so the bound is one value for the whole table.
    """
    last = df.select(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) < F.trunc(F.date_add(last, 1), unit))
