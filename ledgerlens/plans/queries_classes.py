"""Registered queries: ABC / XYZ classification
on mapping A (positive sales only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import register
from ledgerlens.operators.filters import positive_sales
from ledgerlens.plans import classification as C
from ledgerlens.session import scratch
from ledgerlens.sources import sinks
from ledgerlens.sources.fixtures import (BULK_CTE, DAILY_CTE, bulk_items, bulk_log, bulk_type_log,
                                         daily_log)

W = "WITH " + BULK_CTE


def sales(spark, sf):
    return positive_sales(bulk_log(spark, sf))


def type_sales(spark, sf):
    """Sales keyed by part type, with a quarter counter as the period."""
    s = positive_sales(bulk_type_log(spark, sf))
    q = ((F.year("sale_date") - 1995) * 4 + F.quarter("sale_date") - 1).cast("int")
    return s.withColumn("quarter_num", q)


# ----------------------------------------------------------- SQL fragments
_ABC_SQL = """,
abc_totals AS (SELECT {key}, sum(item_cnt_day) AS item_cnt_day FROM {src} GROUP BY {key}),
abc_run AS (SELECT {key}, item_cnt_day,
                   sum(item_cnt_day) OVER (ORDER BY item_cnt_day DESC {frame}) AS cumsum
            FROM abc_totals),
abc AS (SELECT {key}, item_cnt_day, cumsum,
               round(cumsum / (SELECT sum(item_cnt_day) FROM abc_totals), 3) AS percentage
        FROM abc_run),
abc_c AS (SELECT *, CASE WHEN percentage <= 0.6 THEN 'A' WHEN percentage <= 0.8 THEN 'B'
                         WHEN percentage IS NOT NULL THEN 'C' END AS abc FROM abc)"""

_XYZ_SQL = """,
xyz_per AS (SELECT {period}, {key}, sum(item_cnt_day) AS item_cnt_month
            FROM {src} GROUP BY {period}, {key}),
xyz_st AS (SELECT {key}, avg(item_cnt_month) AS mean, stddev_pop(item_cnt_month) AS std
           FROM xyz_per GROUP BY {key}),
xyz_c AS (SELECT {key}, round(mean, 6) AS mean, round(std, 6) AS std,
                 round(std / nullif(mean, 0), 3) AS var_coeff,
                 CASE WHEN round(std / nullif(mean, 0), 3) <= 0.1 THEN 'X'
                      WHEN round(std / nullif(mean, 0), 3) <= 0.25 THEN 'Y'
                      WHEN std / nullif(mean, 0) IS NOT NULL THEN 'Z' END AS xyz
          FROM xyz_st)"""

_XYZ_ZERO_SQL = """,
xyz_per AS (SELECT {period}, {key}, sum(item_cnt_day) AS item_cnt_month
            FROM {src} GROUP BY {period}, {key}),
xyz_grid AS (SELECT {key}, {period}, coalesce(item_cnt_month, 0) AS units
             FROM (SELECT DISTINCT {key} FROM xyz_per) CROSS JOIN (SELECT DISTINCT {period} FROM {src})
             LEFT JOIN xyz_per USING ({key}, {period})),
xyz_st AS (SELECT {key}, avg(units) AS mean, stddev_pop(units) AS std FROM xyz_grid GROUP BY {key}),
xyz_c AS (SELECT {key}, round(mean, 6) AS mean, round(std, 6) AS std,
                 round(std / nullif(mean, 0), 3) AS var_coeff,
                 CASE WHEN round(std / nullif(mean, 0), 3) <= 0.1 THEN 'X'
                      WHEN round(std / nullif(mean, 0), 3) <= 0.25 THEN 'Y'
                      WHEN std / nullif(mean, 0) IS NOT NULL THEN 'Z' END AS xyz
          FROM xyz_st)"""

_RANGE = ""
_ROWS = ", item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

_TYPE_SRC = """,
type_sales AS (
  SELECT s.*, p.p_type AS item_key,
         CAST((year(s.sale_date) - 1995) * 4 + quarter(s.sale_date) - 1 AS INTEGER) AS quarter_num
  FROM bulk_sales s JOIN part p ON p.p_partkey = s.item_id)"""


def _abc(key="item_id", src="bulk_sales", frame=_RANGE):
    return _ABC_SQL.format(key=key, src=src, frame=frame)


def _xyz(key="item_id", src="bulk_sales", period="month_num", zero=False):
    return (_XYZ_ZERO_SQL if zero else _XYZ_SQL).format(key=key, src=src, period=period)


_CLASSES_ITEM = W + _abc() + _xyz() + """,
classes AS (SELECT a.item_id, a.abc, x.xyz FROM abc_c a JOIN xyz_c x ON a.item_id = x.item_id)"""

_CLASSES_TYPE = W + _TYPE_SRC + _abc("item_key", "type_sales") + \
    _xyz("item_key", "type_sales", "quarter_num") + """,
classes AS (SELECT a.item_key, a.abc, x.xyz FROM abc_c a JOIN xyz_c x ON a.item_key = x.item_key)"""

_REVENUE = """,
rev AS (SELECT {key}, CAST(sum(CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4)))
                      AS DOUBLE) AS total_sale
        FROM {src} GROUP BY {key})"""


# ------------------------------------------------------------------ queries
@register("abc_analysis", W + _abc() + "\nSELECT * FROM abc_c")
def q_abc(spark, sf):
    return C.abc_analysis(sales(spark, sf))


@register("abc_analysis_rows", W + _abc(frame=_ROWS) + "\nSELECT * FROM abc_c")
def q_abc_rows(spark, sf):
    return C.abc_analysis(sales(spark, sf), frame="rows")


@register("abc_analysis_by_type", W + _TYPE_SRC + _abc("item_key", "type_sales")
          + "\nSELECT * FROM abc_c")
def q_abc_type(spark, sf):
    return C.abc_analysis(type_sales(spark, sf), key="item_key")


@register("abc_analysis_rows_by_type", W + _TYPE_SRC
          + _abc("item_key", "type_sales", _ROWS.replace("item_id", "item_key")) + "\nSELECT * FROM abc_c")
def q_abc_rows_type(spark, sf):
    return C.abc_analysis(type_sales(spark, sf), key="item_key", frame="rows")


@register("xyz_analysis", W + _xyz() + "\nSELECT * FROM xyz_c")
def q_xyz(spark, sf):
    return C.xyz_analysis(sales(spark, sf))


@register("xyz_analysis_zero_fill", W + _xyz(zero=True) + "\nSELECT * FROM xyz_c")
def q_xyz_zero(spark, sf):
    return C.xyz_analysis(sales(spark, sf), zero_fill=True)


@register("xyz_analysis_by_type_quarter", W + _TYPE_SRC
          + _xyz("item_key", "type_sales", "quarter_num") + "\nSELECT * FROM xyz_c")
def q_xyz_type(spark, sf):
    return C.xyz_analysis(type_sales(spark, sf), key="item_key", period="quarter_num")


@register("abc_xyz", _CLASSES_ITEM + "\nSELECT * FROM classes")
def q_abc_xyz(spark, sf):
    return C.abc_xyz(sales(spark, sf))


_GRID = """,
pairs AS (SELECT a.abc, x.xyz FROM (VALUES ('A'), ('B'), ('C')) a(abc),
                                   (VALUES ('X'), ('Y'), ('Z')) x(xyz)),
counts AS (SELECT abc, xyz, count(*) AS cnt FROM classes GROUP BY abc, xyz),
grid AS (SELECT p.abc, p.xyz, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
         FROM pairs p LEFT JOIN counts c ON p.abc = c.abc AND p.xyz = c.xyz)"""


@register("abc_xyz_grid", _CLASSES_ITEM + _GRID + "\nSELECT * FROM grid ORDER BY abc, xyz")
def q_grid(spark, sf):
    return C.abc_xyz_grid(C.abc_xyz(sales(spark, sf)))


@register("abc_xyz_grid_pivot", _CLASSES_ITEM + _GRID + """
SELECT abc, CAST(sum(CASE WHEN xyz = 'X' THEN count END) AS BIGINT) AS X,
            CAST(sum(CASE WHEN xyz = 'Y' THEN count END) AS BIGINT) AS Y,
            CAST(sum(CASE WHEN xyz = 'Z' THEN count END) AS BIGINT) AS Z
FROM grid GROUP BY abc ORDER BY abc""")
def q_grid_pivot(spark, sf):
    return C.abc_xyz_grid(C.abc_xyz(sales(spark, sf)), pivot=True)


@register("abc_xyz_grid_by_type_quarter", _CLASSES_TYPE + _GRID
          + "\nSELECT * FROM grid ORDER BY abc, xyz")
def q_grid_type(spark, sf):
    s = type_sales(spark, sf)
    return C.abc_xyz_grid(C.abc_xyz(s, key="item_key", period="quarter_num"))


def _top_daily(abc, xyz):
    sql = ("WITH " + DAILY_CTE + """,
daily_sales AS (SELECT * FROM daily_log WHERE item_cnt_day > 0)""" + _abc("item_id", "daily_sales")
           + _xyz("item_id", "daily_sales", "month_num") + """,
classes AS (SELECT a.item_id, a.abc, x.xyz FROM abc_c a JOIN xyz_c x ON a.item_id = x.item_id)"""
           + _REVENUE.format(key="item_id", src="daily_sales") + f"""
SELECT c.item_id AS item_key, c.abc, c.xyz, r.total_sale
FROM classes c JOIN rev r ON c.item_id = r.item_id
WHERE c.abc = '{abc}' AND c.xyz = '{xyz}'
ORDER BY r.total_sale DESC, c.item_id LIMIT 10""")

    def run(spark, sf):
        log = positive_sales(daily_log(spark, sf)).withColumn("item_key", F.col("item_id"))
        per = C.period_totals(log, "item_key", "month_num", with_revenue=True)
        classes = C.abc_xyz(None, key="item_key", period="month_num", per=per)
        return C.top_sales_in_class(classes, None, None, abc, xyz, key="item_key",
                                    revenue=C.revenue_from_periods(per, "item_key"))
    return sql, run


def _top_item(abc, xyz):
    sql = (_CLASSES_ITEM + _REVENUE.format(key="item_id", src="bulk_sales") + f"""
SELECT c.item_id, c.abc, c.xyz, r.total_sale, i.item_name, i.item_category_id
FROM classes c JOIN rev r ON c.item_id = r.item_id JOIN bulk_items i ON i.item_id = c.item_id
WHERE c.abc = '{abc}' AND c.xyz = '{xyz}'
ORDER BY r.total_sale DESC, c.item_id LIMIT 10""")

    def run(spark, sf):
        per = C.period_totals(sales(spark, sf), with_revenue=True)
        return C.top_sales_in_class(C.abc_xyz(None, per=per), None, bulk_items(spark, sf),
                                    abc, xyz, revenue=C.revenue_from_periods(per))
    return sql, run


for _a, _x in [("A", "X"), ("B", "X"), ("C", "X")]:
    _sql, _run = _top_daily(_a, _x)
    register(f"top_sales_in_class_{_a.lower()}{_x.lower()}", _sql)(_run)

for _a, _x in [("A", "Z"), ("B", "Z"), ("C", "Z")]:
    _sql, _run = _top_item(_a, _x)
    register(f"top_sales_in_class_{_a.lower()}{_x.lower()}_items", _sql)(_run)


@register("top_items_per_class", _CLASSES_ITEM + """,
units AS (SELECT item_id, sum(item_cnt_day) AS item_cnt_day FROM bulk_sales GROUP BY item_id),
ranked AS (SELECT c.item_id, c.abc, c.xyz, u.item_cnt_day,
                  row_number() OVER (PARTITION BY c.abc, c.xyz
                                     ORDER BY u.item_cnt_day DESC, c.item_id) AS rn
           FROM classes c JOIN units u ON c.item_id = u.item_id)
SELECT r.item_id, r.abc, r.xyz, r.item_cnt_day, i.item_name
FROM ranked r JOIN bulk_items i ON i.item_id = r.item_id WHERE rn <= 10""")
def q_top_items_per_class(spark, sf):
    per = C.period_totals(sales(spark, sf))
    units = per.groupBy("item_id").agg(F.sum("item_cnt_month").alias("item_cnt_day"))
    return C.top_items_per_class(C.abc_xyz(None, per=per), bulk_items(spark, sf), units)


@register("abc_class_share", W + _abc() + """
SELECT abc, count(*) AS items, round(count(*) / (SELECT count(*) FROM abc_c), 5) AS share,
       printf('%.3f%%', count(*) * 100.0 / (SELECT count(*) FROM abc_c)) AS share_text
FROM abc_c GROUP BY abc""")
def q_abc_share(spark, sf):
    return C.item_share_by_class(C.abc_analysis(sales(spark, sf)))


# ------------------------------------------------------- missing quantities
_GAPS = W + """,
gaps AS (SELECT item_id, CASE WHEN item_id % 7 <> 0 THEN item_cnt_day END AS item_cnt_day FROM bulk_sales)"""


def gap_sales(spark, sf):
    """Sales in which the quantities of every seventh item are missing."""
    return sales(spark, sf).select("item_id", F.when(F.col("item_id") % 7 != 0, F.col("item_cnt_day"))
                                   .alias("item_cnt_day"))


@register("abc_analysis_missing_units", _GAPS + _ABC_SQL.format(
    key="item_id", src="gaps", frame="NULLS LAST") + "\nSELECT * FROM abc_c")
def q_abc_gaps(spark, sf):
    """An item without any known quantity stays, last in the order."""
    return C.abc_analysis(gap_sales(spark, sf))


@register("abc_analysis_rows_missing_units", _GAPS + _ABC_SQL.format(
    key="item_id", src="gaps",
    frame="NULLS LAST, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    + "\nSELECT * FROM abc_c")
def q_abc_rows_gaps(spark, sf):
    """As :func:`q_abc_gaps`, row by row."""
    return C.abc_analysis(gap_sales(spark, sf), frame="rows")


# ------------------------------------------------------ totals kept by load
@register("abc_xyz_incremental", W + _ABC_SQL.format(key="item_id", src="bulk_sales", frame="")
          + _XYZ_SQL.format(key="item_id", period="month_num", src="bulk_sales") + """
SELECT item_id, abc, xyz FROM abc_c JOIN xyz_c USING (item_id)""")
def q_incremental(spark, sf):
    """R7 from totals kept per load: a back-fill, its totals, then the last
    month as a load of its own, the only one read anew."""
    from ledgerlens.plans import partials
    log, table, store = bulk_log(spark, sf), scratch(spark, "by-load"), scratch(spark, "load-totals")
    newest = log.select(F.max("month_num")).scalar()
    sinks.write_sales_log(log.filter(F.col("month_num") < newest), table)
    partials.update(spark, table, store)
    sinks.append_sales(log.filter(F.col("month_num") == newest), table)
    if partials.update(spark, table, store) != 1:
        raise AssertionError("more than the new load was read")
    return C.abc_xyz(None, per=partials.period_totals(partials.read(spark, table, store)))
