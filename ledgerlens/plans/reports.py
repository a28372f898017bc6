"""The four daily reports over the latest day of the sales log.

Reports read the whole log, returns included. Each report scans only the
columns it needs; the latest date is a scalar subquery computed once. When
``month_col`` names a month counter that grows with the date (the partition
column of the ingested table), the scans are restricted to the newest one or
two months, which Spark turns into partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import amount_to_double, sum_amount
from ledgerlens.operators.filters import latest_day, max_date, recent_months
from ledgerlens.operators.joins import join_dimension, join_items

TOP_K = 10


def report_by_category(log: DataFrame, items: DataFrame, categories: DataFrame,
                       month_col: str | None = None) -> DataFrame:
    """Units and revenue per category on the latest day, ascending revenue.

    Rows are reduced to one per item before the dimension joins, so the joins
    see at most one row per item sold that day.
    """
    day = latest_day(log, month_col=month_col)
    per_item = day.groupBy("item_id").agg(
        F.sum("item_cnt_day").alias("num_sold"),
        sum_amount("item_price", "item_cnt_day").alias("sales"))
    star = join_dimension(join_items(per_item, items.select("item_id", "item_category_id")),
                          categories, "item_category_id")
    return (star.groupBy("item_category_id", "item_category_name")
            .agg(F.sum("num_sold").alias("num_sold"),
                 amount_to_double(F.sum("sales")).alias("sales"))
            .orderBy(F.asc("sales"), F.asc("item_category_id")))


def report_top_goods(log: DataFrame, items: DataFrame, k: int = TOP_K,
                     month_col: str | None = None) -> DataFrame:
    """R2: the ``k`` items with the most sale rows on the latest day."""
    day = latest_day(log, month_col=month_col)
    counts = day.groupBy("item_id").agg(F.count("item_cnt_day").alias("daily_count"))
    named = join_items(counts, items.select("item_id", "item_name"))
    return (named.select("item_id", "item_name", "daily_count")
            .orderBy(F.desc("daily_count"), F.asc("item_id")).limit(k))


def report_top_goods_sale(log: DataFrame, items: DataFrame, k: int = TOP_K,
                          month_col: str | None = None) -> DataFrame:
    """The ``k`` items with the most revenue on the latest day."""
    day = latest_day(log, month_col=month_col)
    sale = day.groupBy("item_id").agg(
        amount_to_double(sum_amount("item_price", "item_cnt_day")).alias("sale"))
    named = join_items(sale, items.select("item_id", "item_name"))
    return (named.select("item_id", "item_name", "sale")
            .orderBy(F.desc("sale"), F.asc("item_id")).limit(k))


def day_over_day(log: DataFrame, how: str = "inner",
                 month_col: str | None = None) -> DataFrame:
    """Units per item on the latest day and on the calendar day before.

    One pass with conditional sums instead of two aggregates and a join.
    ``how="inner"`` keeps items sold on both days (the report's semantics);
    ``how="outer"`` counts a missing day as 0.
    """
    last = max_date(log, month_col=month_col)
    prev = F.date_sub(last, 1)
    d, q = F.col("sale_date"), F.col("item_cnt_day")
    two_days = recent_months(log, month_col, 2).filter((d == last) | (d == prev))
    per_item = two_days.groupBy("item_id").agg(
        F.sum(F.when(d == last, q)).alias("last_total"),
        F.sum(F.when(d == prev, q)).alias("prev_total"),
        F.count(F.when(d == last, F.lit(1))).alias("_n_last"),
        F.count(F.when(d == prev, F.lit(1))).alias("_n_prev"))
    if how == "inner":
        per_item = per_item.filter((F.col("_n_last") > 0) & (F.col("_n_prev") > 0))
    elif how == "outer":
        per_item = per_item.select(
            "item_id", F.coalesce("last_total", F.lit(0.0)).alias("last_total"),
            F.coalesce("prev_total", F.lit(0.0)).alias("prev_total"))
    else:
        raise ValueError(f"unknown how {how!r}")
    return per_item.select(last.alias("sale_date"), "item_id", "last_total", "prev_total")


def report_top_difference(log: DataFrame, items: DataFrame, k: int = TOP_K,
                          how: str = "inner", month_col: str | None = None) -> DataFrame:
    """The ``k`` items with the largest absolute change in units between
    the latest day and the day before."""
    dod = day_over_day(log, how=how, month_col=month_col).select(
        "sale_date", "item_id",
        F.abs(F.col("last_total") - F.col("prev_total")).alias("difference"))
    named = join_items(dod, items.select("item_id", "item_name"))
    return (named.select("sale_date", "item_id", "item_name", "difference")
            .orderBy(F.desc("difference"), F.asc("item_id")).limit(k))


# ---------------------------------------------------------------- SQL form
# The same reports as Spark SQL over the tables ``sales_log``, ``items`` and
# ``item_categories``, which the session fills in. All four start from one reduction: per item, what the
# newest day and the day before it sold, in a single pass with conditional
# sums; names are joined to the reduced rows.
_PER_ITEM = """
        WITH dated AS (
          SELECT *, (SELECT max(sale_date) FROM {sales_log}) AS at FROM {sales_log}),
        per_item AS (
          SELECT item_id,
                 count_if(sale_date = at AND item_cnt_day IS NOT NULL) AS n_rows,
                 count_if(sale_date = at) AS n_now,
                 count_if(sale_date < at) AS n_before,
                 sum(item_cnt_day) FILTER (WHERE sale_date = at) AS units,
                 sum(item_cnt_day) FILTER (WHERE sale_date < at) AS units_before,
                 sum(CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4)))
                   FILTER (WHERE sale_date = at) AS revenue,
                 max(at) AS at
          FROM dated
          WHERE sale_date >= date_sub(at, 1)
          GROUP BY item_id)"""
REPORT_SQL = {
    "by_category": _PER_ITEM + """
        SELECT item_category_id, item_category_name, sum(units) AS num_sold,
               CAST(sum(revenue) AS DOUBLE) AS sales
        FROM per_item JOIN {items} USING (item_id) JOIN {item_categories} USING (item_category_id)
        WHERE n_now > 0
        GROUP BY ALL ORDER BY sales, item_category_id""",
    "top_goods": _PER_ITEM + """
        SELECT item_id, item_name, n_rows AS daily_count
        FROM per_item JOIN {items} USING (item_id)
        WHERE n_now > 0
        ORDER BY daily_count DESC, item_id LIMIT :k""",
    "top_goods_sale": _PER_ITEM + """
        SELECT item_id, item_name, CAST(revenue AS DOUBLE) AS sale
        FROM per_item JOIN {items} USING (item_id)
        WHERE n_now > 0
        ORDER BY sale DESC, item_id LIMIT :k""",
    "top_difference": _PER_ITEM + """
        SELECT at AS sale_date, item_id, item_name, abs(units - units_before) AS difference
        FROM per_item JOIN {items} USING (item_id)
        WHERE n_now > 0 AND n_before > 0
        ORDER BY difference DESC, item_id LIMIT :k""",
}


def register_model(spark: SparkSession, log: DataFrame, items: DataFrame,
                   categories: DataFrame) -> None:
    """Name the tables that the SQL reports of this session read. They are kept
    beside the session; its views, whatever their names, stay as they are."""
    spark._ledgerlens_model = {"sales_log": log, "items": items, "item_categories": categories}


def run_report_sql(spark: SparkSession, name: str, k: int = TOP_K) -> DataFrame:
    """Run one SQL report (by_category, top_goods, top_goods_sale, top_difference)."""
    text = REPORT_SQL[name]
    return spark.sql(text, args={"k": k} if ":k" in text else None, **spark._ledgerlens_model)
