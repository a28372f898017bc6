"""Registered queries: revenue calendar (R13, A9, A18-A23, X9-X16) and the
top-5 category calendar (R14, O3, F4, A10, A24-A27) on mapping A."""

from __future__ import annotations

from ledgerlens.catalog import register
from ledgerlens.operators.filters import positive_sales
from ledgerlens.plans import calendar as K
from ledgerlens.sources.fixtures import BULK_CTE, bulk_categories, bulk_items, bulk_log

W = "WITH " + BULK_CTE


def sales(spark, sf):
    return positive_sales(bulk_log(spark, sf))


def model(spark, sf):
    return sales(spark, sf), bulk_items(spark, sf), bulk_categories(spark, sf)


_AMOUNT = "CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4))"

_DAILY = f""",
daily AS (SELECT sale_date, month_num {{keys}}, sum({_AMOUNT}) AS dec_sale
          FROM {{src}} GROUP BY sale_date, month_num {{keys}}),
first_day AS (SELECT min(sale_date) AS d0 FROM daily),
cal AS (
  SELECT d.*, CAST(dec_sale AS DOUBLE) AS total_daily_sale,
         CAST(date_diff('day', CAST(f.d0 - CAST(isodow(f.d0) - 1 AS INTEGER) AS DATE),
                        CAST(d.sale_date - CAST(isodow(d.sale_date) - 1 AS INTEGER) AS DATE)) // 7
              AS INTEGER) AS week_num,
         CAST(date_diff('day', f.d0, d.sale_date) AS INTEGER) AS day_num,
         CAST(isodow(d.sale_date) - 1 AS INTEGER) AS day_of_the_week,
         CAST(day(d.sale_date) AS INTEGER) AS day_of_the_month,
         CAST(weekofyear(d.sale_date) AS INTEGER) AS week_of_the_year,
         CAST(month(d.sale_date) AS INTEGER) AS month_of_the_year,
         CAST(d.sale_date - CAST(isodow(d.sale_date) - 1 AS INTEGER) AS DATE) AS week_monday,
         dayname(d.sale_date) AS day_name
  FROM daily d, first_day f)"""

_TOP5 = """,
per_item AS (SELECT item_id, sum(item_cnt_day) AS u FROM bulk_sales GROUP BY item_id),
top5 AS (SELECT c.item_category_id, c.item_category_name, sum(p.u) AS sales_sum
         FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id
         JOIN bulk_categories c ON c.item_category_id = i.item_category_id
         GROUP BY c.item_category_id, c.item_category_name
         ORDER BY sales_sum DESC, c.item_category_id LIMIT 5),
top_sales AS (SELECT s.*, t.item_category_id, t.item_category_name
              FROM bulk_sales s JOIN bulk_items i ON s.item_id = i.item_id
              JOIN top5 t ON t.item_category_id = i.item_category_id)"""

_CAT_KEYS = ", item_category_id, item_category_name"
_PLAIN = W + _DAILY.format(keys="", src="bulk_sales")
_BYCAT = W + _TOP5 + _DAILY.format(keys=_CAT_KEYS, src="top_sales")

_CAL_COLS = ("day_num, week_num, month_num, total_daily_sale, day_of_the_week, "
             "day_of_the_month, week_of_the_year, month_of_the_year, week_monday")


@register("revenue_by_day", W + f"""
SELECT sale_date, month_num, CAST(sum({_AMOUNT}) AS DOUBLE) AS total_daily_sale
FROM bulk_sales GROUP BY sale_date, month_num""")
def q_daily(spark, sf):
    return K.daily_revenue(sales(spark, sf))


@register("sales_calendar", _PLAIN + f"\nSELECT sale_date, {_CAL_COLS} FROM cal")
def q_calendar(spark, sf):
    return K.sales_calendar(sales(spark, sf))


@register("weekly_sales", _PLAIN + """
SELECT week_num, min(sale_date) AS week_start_date, min(week_monday) AS week_monday,
       CAST(sum(dec_sale) AS DOUBLE) AS weekly_sale
FROM cal GROUP BY week_num""")
def q_weekly(spark, sf):
    return K.weekly_sales(sales(spark, sf))


@register("monthly_sales", _PLAIN + """
SELECT month_num, min(sale_date) AS month_start_date, CAST(sum(dec_sale) AS DOUBLE) AS monthly_sale
FROM daily GROUP BY month_num""")
def q_monthly(spark, sf):
    return K.monthly_sales(sales(spark, sf))


def _seasonal(kind, col, by_cat):
    extra = ", day_name" if kind == "weekday" else ""
    keys = "item_category_name, " if by_cat else ""
    base = _BYCAT if by_cat else _PLAIN
    sql = base + f"""
SELECT {keys}{col}{extra}, CAST(sum(dec_sale) AS DOUBLE) AS total_daily_sale
FROM cal GROUP BY {keys}{col}{extra}"""

    def run(spark, sf):
        if by_cat:
            return K.category_seasonal_sales(*model(spark, sf), kind)
        return K.seasonal_sales(sales(spark, sf), kind)
    return sql, run


for _kind, _col in K.SEASONAL.items():
    _sql, _run = _seasonal(_kind, _col, False)
    register(f"sales_by_{_kind}", _sql)(_run)
    _sql, _run = _seasonal(_kind, _col, True)
    register(f"category_sales_by_{_kind}", _sql)(_run)


@register("top_categories", W + _TOP5 + "\nSELECT * FROM top5")
def q_top_categories(spark, sf):
    return K.top_categories(*model(spark, sf))


@register("revenue_by_day_category", W + _TOP5 + f"""
SELECT sale_date, month_num, item_category_id, item_category_name,
       CAST(sum({_AMOUNT}) AS DOUBLE) AS total_daily_sale
FROM top_sales GROUP BY sale_date, month_num, item_category_id, item_category_name""")
def q_daily_cat(spark, sf):
    return K.daily_revenue(K.top_category_sales(*model(spark, sf)),
                           "item_category_id", "item_category_name")


@register("category_sales_calendar", _BYCAT + f"""
SELECT sale_date, item_category_id, item_category_name, {_CAL_COLS} FROM cal""")
def q_cat_calendar(spark, sf):
    return K.category_sales_calendar(*model(spark, sf))


@register("category_weekly_sales", _BYCAT + """
SELECT item_category_id, item_category_name, week_num, min(sale_date) AS week_start_date,
       min(week_monday) AS week_monday, CAST(sum(dec_sale) AS DOUBLE) AS weekly_sale
FROM cal GROUP BY item_category_id, item_category_name, week_num""")
def q_cat_weekly(spark, sf):
    return K.category_weekly_sales(*model(spark, sf))
