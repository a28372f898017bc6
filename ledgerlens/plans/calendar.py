"""Revenue over time: daily series with calendar columns, weekly and
monthly totals, and seasonal breakdowns (R13), and the same for the five
best-selling categories (R14).

Daily totals are kept as exact amounts until the last step, so weekly,
monthly and seasonal totals equal the daily total exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates as D
from ledgerlens.functions.numeric import amount_to_double, sum_amount
from ledgerlens.operators.joins import (BROADCAST_BYTES, broadcast_if_subset_small, estimated_bytes,
                                        join_dimension, join_items, join_star)
from ledgerlens.session import materialize

DAY = "total_daily_sale"
_AMT = "_daily_amount"

# The seasonal breakdowns and the column each one groups by.
SEASONAL = {
    "weekday": "day_of_the_week",
    "month_day": "day_of_the_month",
    "year_week": "week_of_the_year",
    "year_month": "month_of_the_year",
}


def daily_revenue(sales: DataFrame, *keys: str, keep_amount: bool = False) -> DataFrame:
    """Revenue per (sale_date, month_num, *keys)."""
    out = sales.groupBy("sale_date", "month_num", *keys).agg(
        sum_amount("item_price", "item_cnt_day").alias(_AMT))
    out = out.withColumn(DAY, amount_to_double(_AMT))
    return out if keep_amount else out.drop(_AMT)


def daily_table(sales: DataFrame, *keys: str) -> DataFrame:
    """The daily table, written once: one row per day (and key). The
    calendar's first-date subquery and every breakdown read it instead of
    the fact table."""
    return materialize(daily_revenue(sales, *keys, keep_amount=True))


def _calendar(daily: DataFrame) -> DataFrame:
    return D.with_calendar(daily, "sale_date").withColumn(
        "week_monday", D.week_start_monday("sale_date"))


def calendar_of_daily(daily: DataFrame, *keys: str) -> DataFrame:
    """R13 columns over a daily table (``sale_date``, ``month_num``, keys,
    exact amount)."""
    return _calendar(daily).select(
        "sale_date", *keys, "day_num", "week_num", "month_num", DAY,
        "day_of_the_week", "day_of_the_month", "week_of_the_year", "month_of_the_year",
        "week_monday")


def weekly_of_daily(daily: DataFrame, *keys: str) -> DataFrame:
    """A18 over a daily table."""
    return _calendar(daily).groupBy(*keys, "week_num").agg(
        F.min("sale_date").alias("week_start_date"),
        F.min("week_monday").alias("week_monday"),
        amount_to_double(F.sum(_AMT)).alias("weekly_sale"))


def seasonal_of_daily(daily: DataFrame, kind: str, *keys: str) -> DataFrame:
    """A20-A27 over a daily table."""
    col = SEASONAL[kind]
    cal = D.with_calendar(daily, "sale_date")
    group = [col] + ([D.weekday_name("sale_date").alias("day_name")] if kind == "weekday" else [])
    return cal.groupBy(*keys, *group).agg(amount_to_double(F.sum(_AMT)).alias(DAY))


def sales_calendar(sales: DataFrame, *keys: str) -> DataFrame:
    """One row per day (and key) with revenue and calendar columns.

    ``week_num`` / ``day_num`` count from the first date of the frame.
    """
    return calendar_of_daily(daily_table(sales, *keys), *keys)


def weekly_sales(sales: DataFrame, *keys: str) -> DataFrame:
    """Per relative week the first sale day, its Monday and revenue."""
    return weekly_of_daily(daily_table(sales, *keys), *keys)


def monthly_sales(sales: DataFrame, *keys: str) -> DataFrame:
    """Per month counter the first sale day and revenue."""
    return monthly_of_daily(daily_revenue(sales, *keys, keep_amount=True), *keys)


def monthly_of_daily(daily: DataFrame, *keys: str) -> DataFrame:
    """A19 over a daily table."""
    return daily.groupBy(*keys, "month_num").agg(
        F.min("sale_date").alias("month_start_date"),
        amount_to_double(F.sum(_AMT)).alias("monthly_sale"))


def seasonal_sales(sales: DataFrame, kind: str, *keys: str) -> DataFrame:
    """Revenue summed by a calendar part, years merged.

    ``kind`` is one of ``weekday`` (0 = Monday, with the day name),
    ``month_day``, ``year_week`` (ISO week) or ``year_month``.
    """
    return seasonal_of_daily(daily_table(sales, *keys), kind, *keys)


def top_categories(sales: DataFrame, items: DataFrame, categories: DataFrame,
                   n: int = 5) -> DataFrame:
    """O3: the ``n`` categories with the most units (ties by id)."""
    # Units per item first: the dimension joins then see one row per item.
    per_item = sales.groupBy("item_id").agg(F.sum("item_cnt_day").alias("item_cnt_day"))
    star = join_star(per_item, items.select("item_id", "item_category_id"), categories)
    return (star.groupBy("item_category_id", "item_category_name")
            .agg(F.sum("item_cnt_day").alias("sales_sum"))
            .orderBy(F.desc("sales_sum"), F.asc("item_category_id")).limit(n))


def top_category_sales(sales: DataFrame, items: DataFrame, categories: DataFrame,
                       n: int = 5) -> DataFrame:
    """F4 + J2: sales rows of the top-``n`` categories, with category columns.

    The top list is at most ``n`` rows (a LIMIT), so it is broadcast.
    """
    top = top_categories(sales, items, categories, n).select(
        "item_category_id", "item_category_name")
    # Items of those categories (a subset of the items, which bound its
    # size), then one join.
    top_items = items.select("item_id", "item_category_id").join(
        F.broadcast(top), "item_category_id", "inner")
    return sales.join(broadcast_if_subset_small(top_items, items), "item_id")


def in_top_categories(sales: DataFrame, items: DataFrame, categories: DataFrame,
                      n: int = 5) -> DataFrame:
    """the sales rows of the top-``n`` categories, each once (semi-join)."""
    top = top_categories(sales, items, categories, n).select("item_category_id")
    top_items = items.join(F.broadcast(top), "item_category_id", "left_semi").select("item_id")
    return sales.join(broadcast_if_subset_small(top_items, items), "item_id", "left_semi")


CATEGORY_KEYS = ("item_category_id", "item_category_name")


def category_daily(sales: DataFrame | None, items: DataFrame, categories: DataFrame,
                   n: int = 5, per_item: DataFrame | None = None) -> DataFrame:
    """Daily revenue of the top-``n`` categories from one fact scan.

    Units and amounts are summed per (day, category) for all categories (a
    table of days x categories, written once); the top ``n`` by units are
    chosen from it and kept with a broadcast join of at most ``n`` rows.

    Items within the broadcast bound are joined before the shuffle. Beyond it
    the join has to shuffle too, so the sales are summed per (day, item)
    first and the rows of a hot item do not meet in the join. ``per_item`` gives
    these sums (``_units`` and the amount) where they are known.
    """
    names = items.select("item_id", "item_category_id")
    units, amount = F.sum("item_cnt_day"), sum_amount("item_price", "item_cnt_day")
    day = ["sale_date", "month_num"]
    if per_item is None and estimated_bytes(names) <= BROADCAST_BYTES:
        per_day = join_items(sales, names).groupBy(*day, "item_category_id").agg(
            units.alias("_units"), amount.alias(_AMT))
    else:
        if per_item is None:
            per_item = sales.groupBy(*day, "item_id").agg(units.alias("_units"), amount.alias(_AMT))
        per_day = join_items(per_item, names).groupBy(*day, "item_category_id").agg(
            F.sum("_units").alias("_units"), F.sum(_AMT).alias(_AMT))
    per_day = materialize(per_day)
    units = per_day.groupBy("item_category_id").agg(F.sum("_units").alias("sales_sum"))
    top = (join_dimension(units, categories, "item_category_id")
           .orderBy(F.desc("sales_sum"), F.asc("item_category_id")).limit(n)
           .select(*CATEGORY_KEYS))
    return (per_day.join(F.broadcast(top), "item_category_id", "inner")
            .select("sale_date", "month_num", *CATEGORY_KEYS, _AMT,
                    amount_to_double(_AMT).alias(DAY)))


def category_sales_calendar(sales: DataFrame, items: DataFrame, categories: DataFrame,
                            n: int = 5) -> DataFrame:
    """R13's daily calendar per top-``n`` category."""
    return calendar_of_daily(category_daily(sales, items, categories, n), *CATEGORY_KEYS)


def category_weekly_sales(sales: DataFrame, items: DataFrame, categories: DataFrame,
                          n: int = 5) -> DataFrame:
    """A18 per top-``n`` category."""
    return weekly_of_daily(category_daily(sales, items, categories, n), *CATEGORY_KEYS)


def category_seasonal_sales(sales: DataFrame, items: DataFrame, categories: DataFrame,
                            kind: str, n: int = 5) -> DataFrame:
    """Seasonal revenue per top-``n`` category name."""
    return seasonal_of_daily(category_daily(sales, items, categories, n), kind,
                             "item_category_name")
