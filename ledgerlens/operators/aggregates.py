"""Grouped aggregations of the sales model.

All are hash aggregations; Spark adds the map-side partial step, so a hot
key is combined before the shuffle. Money is summed exactly (see
:mod:`ledgerlens.functions.numeric`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import (amount_to_double, line_total, mean_of_prices, sum_amount,
                                          sum_price)

MEAN_PLACES = 4


def with_total_sale(df: DataFrame, price: str = "item_price",
                    qty: str = "item_cnt_day", out: str = "total_sale") -> DataFrame:
    """The amount of each row, ``price * count``, exact."""
    return df.withColumn(out, line_total(price, qty))


def units_by(df: DataFrame, *keys: str, qty: str = "item_cnt_day",
             out: str = "item_cnt_day") -> DataFrame:
    """Sum of units per key."""
    return df.groupBy(*keys).agg(F.sum(qty).alias(out))


def revenue_by(df: DataFrame, *keys: str, out: str = "total_sale",
               price: str = "item_price", qty: str = "item_cnt_day",
               as_double: bool = True) -> DataFrame:
    """Exact sum of ``price * count`` per key."""
    total = sum_amount(price, qty)
    return df.groupBy(*keys).agg((amount_to_double(total) if as_double else total).alias(out))


def mean_price_by(df: DataFrame, *keys: str, price: str = "item_price",
                  out: str = "mean_price", places: int = MEAN_PLACES) -> DataFrame:
    """Unweighted mean price per sale row, rounded to ``places``.

    The mean is computed from the exact price sum and rounded half up once,
    so it does not depend on the order partitions are combined in.
    """
    mean = mean_of_prices(sum_price(price), F.count(price), places)
    return df.groupBy(*keys).agg(mean.alias(out))


def demand_stats(monthly: DataFrame, key: str = "item_id", value: str = "item_cnt_month",
                 periods=None, places: int = 6) -> DataFrame:
    """A3: mean and population std of per-period units per key.

    With ``periods`` (a Column holding the number of periods) absent periods
    count as zero without a key x period grid: with n periods of mean m and
    std s present, the mean over all N is M = n m / N and the variance
    (n (s^2 + (m - M)^2) + (N - n) M^2) / N, a sum of squares only.
    """
    v = F.col(value)
    mean, std = F.avg(v), F.stddev_pop(v)
    if periods is not None:
        n, here, spread = F.count(v), mean, std
        mean = F.sum(v) / periods
        std = F.sqrt((n * (spread * spread + F.pow(here - mean, F.lit(2.0)))
                      + (periods - n) * mean * mean) / periods)
    return monthly.groupBy(key).agg(mean.alias("mean"), std.alias("std"))


def count_rows_by(df: DataFrame, *keys: str, col: str = "item_cnt_day",
                  out: str = "daily_count") -> DataFrame:
    """Number of non-null ``col`` values (sale rows, not units) per key."""
    return df.groupBy(*keys).agg(F.count(col).alias(out))


def global_counts(sales: DataFrame, key: str = "item_id",
                  date_col: str = "sale_date") -> DataFrame:
    """Rows, distinct items and distinct days, in one pass."""
    return sales.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_distinct(key).alias("items"),
                     F.count_distinct(date_col).alias("days"))


def grand_total(df: DataFrame, col: str = "item_cnt_day", out: str = "total_units") -> DataFrame:
    """Total units (one row)."""
    return df.agg(F.sum(col).alias(out))


def class_share(classes: DataFrame, class_col: str = "abc", places: int = 5) -> DataFrame:
    """Fraction of keys in each class, with a percent label."""
    total = classes.select(F.count(F.lit(1))).scalar()
    share = F.count(F.lit(1)) / total
    return classes.groupBy(class_col).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(share, places).alias("share"),
        F.format_string("%.3f%%", share * 100).alias("share_text"))
