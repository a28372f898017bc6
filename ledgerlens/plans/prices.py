"""Price statistics (R10-R12): mean prices per item and per category,
quantile trimming, outliers, descriptive statistics, histograms and kernel
densities. Everything stays a DataFrame; nothing is pulled to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import mean_of_prices, sum_price
from ledgerlens.operators import stats as S
from ledgerlens.operators.aggregates import mean_price_by
from ledgerlens.operators.joins import broadcast_if_subset_small, join_items, join_star
from ledgerlens.session import materialize

# Histogram bin widths of the item and category price charts,
# and the trimming quantile.
ITEM_BIN_WIDTH = 100
CATEGORY_BIN_WIDTH = 200
TRIM_Q = 0.95


# ------------------------------------------------------------------ items
def mean_product_prices(sales: DataFrame | None, items: DataFrame,
                        summary: DataFrame | None = None) -> DataFrame:
    """A4 + J6: mean price per item (aggregate first, then add names), from
    an :func:`item_summary` if given."""
    means = mean_price_by(sales, "item_id") if summary is None else _means(summary)
    return join_items(means, items.select("item_id", "item_name", "item_category_id"))


def top_mean_price_items(prices: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` dearest items, price rounded to 2 places."""
    return (prices.orderBy(F.desc("mean_price"), F.asc("item_id")).limit(k)
            .select("item_id", "item_name", F.round("mean_price", 2).alias("mean_price")))


def trimmed_prices(prices: DataFrame, q: float = TRIM_Q) -> DataFrame:
    """items priced at most the global ``q`` quantile of mean prices."""
    return S.trim_upper(prices, "mean_price", q)


def price_outliers(prices: DataFrame, q: float = TRIM_Q, k: int = 20) -> DataFrame:
    """F8: the first ``k`` items above the ``q`` quantile, dearest first."""
    return (S.above_quantile(prices, "mean_price", q)
            .orderBy(F.desc("mean_price"), F.asc("item_id")).limit(k))


def price_quantile(prices: DataFrame, q: float = TRIM_Q) -> DataFrame:
    """The exact ``q`` quantile of mean prices (one row)."""
    return S.quantiles(prices, "mean_price", [q], names=["quantile"])


def describe_trimmed_prices(prices: DataFrame, q: float = TRIM_Q) -> DataFrame:
    """describe() of the trimmed mean prices, quartiles exact."""
    return S.describe(trimmed_prices(prices, q), "mean_price", prepared=True)


def item_price_histogram(prices: DataFrame, q: float = TRIM_Q,
                         width: float = ITEM_BIN_WIDTH) -> DataFrame:
    """Trimmed mean prices in ``width``-wide bins."""
    return S.histogram(trimmed_prices(prices, q), "mean_price", width, prepared=True)


def item_price_histogram_auto(prices: DataFrame) -> DataFrame:
    """Untrimmed mean prices with automatic bin width."""
    return S.histogram_auto(prices, "mean_price")


# ------------------------------------------------------------- categories
def _means(summary: DataFrame) -> DataFrame:
    return summary.select("item_id", mean_of_prices("_p_sum", "_p_n").alias("mean_price"))


def item_summary(sales: DataFrame) -> DataFrame:
    """Per item: units, exact price sum and number of priced rows, written
    once. Category ranking and mean prices both derive from it, so the fact
    table is read once."""
    return materialize(sales.groupBy("item_id").agg(
        F.sum("item_cnt_day").alias("item_cnt_day"),
        sum_price("item_price").alias("_p_sum"),
        F.count("item_price").alias("_p_n")))


def top_category_item_prices(sales: DataFrame | None, items: DataFrame, categories: DataFrame,
                             n: int = 5, summary: DataFrame | None = None) -> DataFrame:
    """Mean price per item inside the ``n`` best-selling categories."""
    summary = item_summary(sales) if summary is None else summary
    star = join_star(summary.select("item_id", "item_cnt_day"),
                     items.select("item_id", "item_category_id"), categories)
    top = (star.groupBy("item_category_id", "item_category_name")
           .agg(F.sum("item_cnt_day").alias("sales_sum"))
           .orderBy(F.desc("sales_sum"), F.asc("item_category_id")).limit(n)
           .select("item_category_id", "item_category_name"))
    top_items = items.select("item_id", "item_name", "item_category_id").join(
        F.broadcast(top), "item_category_id", "inner")
    means = _means(summary)
    # The top items are a subset of the items: the items table bounds them.
    return means.join(broadcast_if_subset_small(top_items, items), "item_id").select(
        "item_id", "item_category_id", "item_category_name", "item_name", "mean_price")


def top_category_trimmed(prices: DataFrame, q: float = TRIM_Q) -> DataFrame:
    """per category, items at most that category's ``q`` quantile."""
    return S.trim_upper_per_group(prices, "mean_price", ["item_category_id"], q)


def describe_category_prices(prices: DataFrame, q: float = TRIM_Q) -> DataFrame:
    """describe() of trimmed mean prices for every top category."""
    return S.describe(top_category_trimmed(prices, q), "mean_price",
                      ["item_category_id", "item_category_name"])


def category_price_density(prices: DataFrame, q: float = TRIM_Q,
                           grid_size: int = 200) -> DataFrame:
    """Gaussian kernel density of trimmed mean prices per category."""
    return S.kernel_density(top_category_trimmed(prices, q), "mean_price",
                            ["item_category_id", "item_category_name"], grid_size=grid_size)


def mean_category_prices(sales: DataFrame | None, items: DataFrame, categories: DataFrame,
                         summary: DataFrame | None = None) -> DataFrame:
    """A5: mean price per category over its sale rows (dearest first).

    Price sums and row counts are taken per item first, so the dimension
    joins see one row per item; the mean is still per sale row.
    """
    per_item = summary if summary is not None else sales.groupBy("item_id").agg(
        sum_price("item_price").alias("_p_sum"),
        F.count("item_price").alias("_p_n"))
    star = join_star(per_item.select("item_id", "_p_sum", "_p_n"), items.select("item_id", "item_category_id"), categories)
    mean = mean_of_prices(F.sum("_p_sum"), F.sum("_p_n"))
    return (star.groupBy("item_category_id", "item_category_name")
            .agg(mean.alias("mean_price"))
            .orderBy(F.desc("mean_price"), F.asc("item_category_id")))


def top_mean_price_categories(cat_prices: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` dearest categories."""
    return cat_prices.orderBy(F.desc("mean_price"), F.asc("item_category_id")).limit(k)


def category_price_histogram(cat_prices: DataFrame,
                             width: float = CATEGORY_BIN_WIDTH) -> DataFrame:
    """Category mean prices in ``width``-wide bins."""
    return S.histogram(cat_prices, "mean_price", width)
