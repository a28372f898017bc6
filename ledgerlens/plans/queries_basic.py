"""Registered queries: sources and sinks (S1-S9, K1-K4), streaming ingestion
(S6), single filters / joins / aggregates (F1-F3, J2, A1, A2, A12, A14-A16),
row index (W5), scalar functions (X1-X16) and the SQL class functions
(G1, G2).

Round-trip queries derive their data from the driver tables, write it with
the library's writers to a fresh folder under the shared checkpoint folder,
and return what the readers give back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerlens.catalog import register
from ledgerlens.functions import dates as D
from ledgerlens.functions.classes import register_sql_functions
from ledgerlens.operators import aggregates as A
from ledgerlens.operators.filters import latest_day, max_date, positive_sales, previous_day
from ledgerlens.operators.joins import join_star
from ledgerlens.plans import classification as C
from ledgerlens.plans import prices as P
from ledgerlens.plans import reports
from ledgerlens.schema import ITEMS_SCHEMA
from ledgerlens.session import scratch
from ledgerlens.sources import files, sinks
from ledgerlens.sources.fixtures import (BULK_CTE, DAILY_CTE, bulk_categories, bulk_items,
                                         bulk_log, daily_items, daily_log, daily_model)
from ledgerlens.streaming.ingest import ingest_available

WB = "WITH " + BULK_CTE
WD = "WITH " + DAILY_CTE


# ------------------------------------------------------------ sources/sinks
@register("scan_sales_csv", WD + "\nSELECT * FROM daily_log")
def q_scan_csv(spark, sf):
    path = scratch(spark, "landing")
    sinks.sales_log_to_csv(daily_log(spark, sf), path)
    return files.read_sales_csv(spark, path)


@register("partitioned_fact_roundtrip", WB + "\nSELECT * FROM bulk_log")
def q_partitioned(spark, sf):
    path = scratch(spark, "sales_log")
    sinks.write_sales_log(bulk_log(spark, sf), path)
    return files.read_sales_table(spark, path)


@register("ingest_shared_table", WD + "\nSELECT * FROM daily_log")
def q_ingest_shared(spark, sf):
    log = daily_log(spark, sf)
    table, drop, ckpt = (scratch(spark, n) for n in ("shared", "shared-drop", "shared-ckpt"))
    last = log.select(F.max("sale_date")).scalar()
    sinks.write_sales_log(log.filter(F.col("sale_date") < F.date_sub(last, 2)), table)
    for back in (2, 1):
        day = log.filter(F.col("sale_date") == F.date_sub(last, back))
        sinks.sales_log_to_csv(day, f"{drop}/day-{back}")
        ingest_available(spark, f"{drop}/*", table, ckpt)
    ingest_available(spark, f"{drop}/*", table, ckpt)  # nothing new: adds nothing
    sinks.append_sales(log.filter(F.col("sale_date") == last), table)
    return files.read_sales_table(spark, table)


@register("append_latest_day", WD + "\nSELECT * FROM daily_log")
def q_append(spark, sf):
    log = daily_log(spark, sf)
    path = scratch(spark, "sales_log")
    last = max_date(log)
    sinks.write_sales_log(log.filter(F.col("sale_date") < last), path)
    sinks.append_sales(log.filter(F.col("sale_date") >= last), path)
    return files.read_sales_table(spark, path)


@register("ingest_stream", WD + "\nSELECT * FROM daily_log")
def q_ingest(spark, sf):
    drop, table = scratch(spark, "drop"), scratch(spark, "table")
    sinks.sales_log_to_csv(daily_log(spark, sf), drop)
    ingest_available(spark, drop, table, scratch(spark, "stream-ckpt"))
    return files.read_sales_table(spark, table)


@register("dimension_roundtrip", WD + "\nSELECT item_name, item_id, item_category_id FROM daily_items")
def q_dimension(spark, sf):
    csv_path, table = scratch(spark, "items-csv"), scratch(spark, "items")
    items = daily_items(spark, sf).select(*ITEMS_SCHEMA.fieldNames())
    sinks.write_csv(items, csv_path, quote_all=True)
    sinks.load_dimension(files.read_items_csv(spark, csv_path), table)
    return files.load(spark, table)


_TOP_SALE = WD + """
SELECT item_id, item_name, CAST(sum(item_price::DECIMAL(18,6)
                                    * item_cnt_day::DECIMAL(18,4)) AS DOUBLE) AS sale
FROM daily_log JOIN daily_items USING (item_id)
WHERE sale_date = (SELECT max(sale_date) FROM daily_log)
GROUP BY ALL ORDER BY sale DESC, item_id LIMIT 10"""


@register("report_csv_roundtrip", _TOP_SALE)
def q_report_csv(spark, sf):
    log, items, _ = daily_model(spark, sf)
    path = scratch(spark, "report")
    sinks.write_report(reports.report_top_goods_sale(log, items), path)
    return files.read_dim_csv(spark, path, "item_id long, item_name string, sale double")


@register("tsv_report_to_csv", WD + """
SELECT CAST(s.item_id AS VARCHAR) AS item_id, i.item_name,
       CAST(count(s.item_cnt_day) AS VARCHAR) AS daily_count
FROM daily_log s JOIN daily_items i ON s.item_id = i.item_id
WHERE s.sale_date IN (SELECT max(sale_date) FROM daily_log)
GROUP BY s.item_id, i.item_name
ORDER BY count(s.item_cnt_day) DESC, s.item_id LIMIT 10""")
def q_tsv(spark, sf):
    log, items, _ = daily_model(spark, sf)
    tsv, csv = scratch(spark, "tsv"), scratch(spark, "csv")
    (reports.report_top_goods(log, items).coalesce(1).write.option("sep", "\t")
     .option("header", "true").csv(tsv))
    sinks.tsv_to_csv(spark, tsv, csv)
    return spark.read.options(**files.QUOTED_CSV_OPTIONS).csv(csv)


@register("indexed_category_prices", WB + """,
per_item AS (SELECT item_id, sum(CAST(CAST(item_price AS DECIMAL(18,6)) * 1000000 AS HUGEINT)) AS ps,
                    count(item_price) AS pn
             FROM bulk_sales GROUP BY item_id),
catp AS (SELECT c.item_category_id, c.item_category_name,
                CAST((sum(p.ps) * 2 + 100 * sum(p.pn)) // (200 * sum(p.pn)) AS DOUBLE) / 10000.0 AS mean_price
         FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id
         JOIN bulk_categories c ON c.item_category_id = i.item_category_id
         GROUP BY c.item_category_id, c.item_category_name)
SELECT CAST(row_number() OVER (ORDER BY mean_price DESC, item_category_id) - 1 AS INTEGER) AS index,
       * FROM catp""")
def q_indexed(spark, sf):
    cat = P.mean_category_prices(positive_sales(bulk_log(spark, sf)), bulk_items(spark, sf),
                                 bulk_categories(spark, sf))
    path = scratch(spark, "indexed")
    sinks.write_indexed_report(cat, path, "mean_price", "item_category_id")
    return files.read_dim_csv(spark, path, "index int, item_category_id int, "
                              "item_category_name string, mean_price double")


@register("indexed_product_prices", WB + """,
per_item AS (SELECT item_id, sum(CAST(CAST(item_price AS DECIMAL(18,6)) * 1000000 AS HUGEINT)) AS ps,
                    count(item_price) AS pn
             FROM bulk_sales GROUP BY item_id),
mp AS (SELECT p.item_id, i.item_name, CAST((ps * 2 + 100 * pn) // (200 * pn) AS DOUBLE) / 10000.0 AS mean_price
       FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id)
SELECT row_number() OVER (ORDER BY mean_price DESC, item_id) - 1 AS index, * FROM mp""")
def q_indexed_items(spark, sf):
    """K2 at item scale: the indexed price list of all items, read back."""
    prices = P.mean_product_prices(positive_sales(bulk_log(spark, sf)), bulk_items(spark, sf))
    path = scratch(spark, "indexed-items")
    sinks.write_indexed_report(prices.select("item_id", "item_name", "mean_price"), path,
                               "mean_price", "item_id")
    return files.read_dim_csv(spark, path, "index long, item_id long, item_name string, "
                              "mean_price double")


@register("first_files_by_time", WD + """
SELECT * FROM daily_log WHERE sale_date = (SELECT max(sale_date) FROM daily_log) - 1""")
def q_first_files(spark, sf):
    """Three loads land one after the other (older days, the day before
    the last, the last day); the files of the second are read by their place
    in time."""
    log = daily_log(spark, sf)
    root = scratch(spark, "timed")
    last = log.select(F.max("sale_date")).scalar()
    d, prev = F.col("sale_date"), F.date_sub(last, 1)
    loads = {"older": d < prev, "previous": d == prev, "last": d == last}
    for name, rows in loads.items():
        sinks.sales_log_to_csv(log.filter(rows), f"{root}/{name}")
    older, previous = (files.count_files(spark, f"{root}/{n}") for n in ("older", "previous"))
    return files.read_first_n_files(spark, f"{root}/*", n=previous, skip=older)


# ------------------------------------------------------- filters and joins
@register("filter_positive_sales", WB + "\nSELECT * FROM bulk_sales")
def q_positive(spark, sf):
    return positive_sales(bulk_log(spark, sf))


@register("latest_day_rows", WD + "\nSELECT * FROM daily_log WHERE sale_date = (SELECT max(sale_date) FROM daily_log)")
def q_latest(spark, sf):
    return latest_day(daily_log(spark, sf))


@register("previous_day_rows", WD + "\nSELECT * FROM daily_log WHERE sale_date + 1 = (SELECT max(sale_date) FROM daily_log)")
def q_previous(spark, sf):
    return previous_day(daily_log(spark, sf))


@register("join_star_sales", WB + """
SELECT s.*, i.item_name, c.item_category_id, c.item_category_name
FROM bulk_sales s JOIN bulk_items i ON s.item_id = i.item_id
JOIN bulk_categories c ON c.item_category_id = i.item_category_id""")
def q_join_star(spark, sf):
    return join_star(positive_sales(bulk_log(spark, sf)), bulk_items(spark, sf),
                     bulk_categories(spark, sf))


# --------------------------------------------------------------- aggregates
@register("units_by_item", WB + "\nSELECT item_id, sum(item_cnt_day) AS item_cnt_day FROM bulk_sales GROUP BY item_id")
def q_units_item(spark, sf):
    return A.units_by(positive_sales(bulk_log(spark, sf)), "item_id")


@register("units_by_month_item", WB + """
SELECT month_num, item_id, sum(item_cnt_day) AS item_cnt_month FROM bulk_sales GROUP BY month_num, item_id""")
def q_units_month(spark, sf):
    return A.units_by(positive_sales(bulk_log(spark, sf)), "month_num", "item_id",
                      out="item_cnt_month")


@register("count_rows_by_item", WD + """
SELECT item_id, count(item_cnt_day) AS daily_count FROM daily_log GROUP BY item_id""")
def q_count_rows(spark, sf):
    return A.count_rows_by(daily_log(spark, sf), "item_id")


@register("global_counts", WB + """
SELECT count(*) AS rows, count(DISTINCT item_id) AS items, count(DISTINCT sale_date) AS days
FROM bulk_sales""")
def q_global_counts(spark, sf):
    return A.global_counts(positive_sales(bulk_log(spark, sf)))


@register("grand_total_units", WB + "\nSELECT sum(item_cnt_day) AS total_units FROM bulk_sales")
def q_grand_total(spark, sf):
    return A.grand_total(positive_sales(bulk_log(spark, sf)))


@register("max_sale_date", WD + "\nSELECT max(sale_date) AS max_sale_date FROM daily_log")
def q_max_date(spark, sf):
    log = daily_log(spark, sf)
    return log.agg(F.max("sale_date").alias("max_sale_date"))


@register("revenue_by_item", WB + """
SELECT item_id, CAST(sum(CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4)))
       AS DOUBLE) AS total_sale
FROM bulk_sales GROUP BY item_id""")
def q_revenue_item(spark, sf):
    return A.revenue_by(positive_sales(bulk_log(spark, sf)), "item_id")


# ------------------------------------------------------- scalar functions
@register("calendar_functions", WB + """,
days AS (SELECT DISTINCT sale_date FROM bulk_log),
d0 AS (SELECT min(sale_date) AS first FROM days)
SELECT sale_date,
       strftime(sale_date, '%d.%m.%Y') AS sale_date_text,
       CAST(strptime(strftime(sale_date, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS parsed,
       sale_date + 1 AS next_day,
       CAST(isodow(sale_date) - 1 AS INTEGER) AS weekday,
       dayname(sale_date) AS weekday_name,
       CAST(day(sale_date) AS INTEGER) AS day_of_month,
       CAST(weekofyear(sale_date) AS INTEGER) AS week_of_year,
       CAST(month(sale_date) AS INTEGER) AS month_of_year,
       CAST(sale_date - CAST(isodow(sale_date) - 1 AS INTEGER) AS DATE) AS week_monday,
       CAST(date_diff('day', CAST(first - CAST(isodow(first) - 1 AS INTEGER) AS DATE),
                      CAST(sale_date - CAST(isodow(sale_date) - 1 AS INTEGER) AS DATE)) // 7
            AS INTEGER) AS relative_week,
       CAST(date_diff('day', first, sale_date) AS INTEGER) AS relative_day
FROM days, d0""")
def q_calendar_functions(spark, sf):
    days = bulk_log(spark, sf).select("sale_date").distinct()
    first = days.select(F.min("sale_date")).scalar()
    d = F.col("sale_date")
    text = D.format_date(d)
    return days.select(
        d, text.alias("sale_date_text"), D.parse_date(text).alias("parsed"),
        D.add_days(d, 1).alias("next_day"), D.weekday(d).alias("weekday"),
        D.weekday_name(d).alias("weekday_name"), D.day_of_month(d).alias("day_of_month"),
        D.week_of_year(d).alias("week_of_year"), D.month_of_year(d).alias("month_of_year"),
        D.week_start_monday(d).alias("week_monday"),
        D.relative_week(d, first).alias("relative_week"),
        D.relative_day(d, first).alias("relative_day"))


_ABC_SQL = WB + """,
t AS (SELECT item_id, sum(item_cnt_day) AS u FROM bulk_sales GROUP BY item_id),
r AS (SELECT item_id, round(sum(u) OVER (ORDER BY u DESC) / (SELECT sum(u) FROM t), 3) AS p FROM t)
SELECT item_id, p AS percentage,
       CASE WHEN p <= 0.6 THEN 'A' WHEN p <= 0.8 THEN 'B' WHEN p IS NOT NULL THEN 'C' END AS abc
FROM r"""


@register("abc_sql_function", _ABC_SQL)
def q_abc_sql(spark, sf):
    """G1: the SQL function ``abc_class`` applied in Spark SQL."""
    register_sql_functions(spark)
    shares = C.abc_analysis(positive_sales(bulk_log(spark, sf)))
    return spark.sql("SELECT item_id, percentage, abc_class(percentage) AS abc FROM {shares}",
                     shares=shares)


@register("xyz_sql_function", WB + """,
per AS (SELECT month_num, item_id, sum(item_cnt_day) AS m FROM bulk_sales GROUP BY month_num, item_id),
st AS (SELECT item_id, round(stddev_pop(m) / nullif(avg(m), 0), 3) AS v FROM per GROUP BY item_id)
SELECT item_id, v AS var_coeff,
       CASE WHEN v <= 0.1 THEN 'X' WHEN v <= 0.25 THEN 'Y' WHEN v IS NOT NULL THEN 'Z' END AS xyz
FROM st""")
def q_xyz_sql(spark, sf):
    """The SQL function ``xyz_class`` applied in Spark SQL."""
    register_sql_functions(spark)
    variation = C.xyz_analysis(positive_sales(bulk_log(spark, sf)))
    return spark.sql("SELECT item_id, var_coeff, xyz_class(var_coeff) AS xyz FROM {variation}",
                     variation=variation)


# ------------------------------------------------------------ more §2 rows
@register("scan_table", "SELECT * FROM part")
def q_scan_table(spark, sf):
    """A stored table by path."""
    return files.load(spark, os.path.join(sf, "part.parquet"))


@register("scan_catalog_table", WB + "\nSELECT * FROM bulk_log")
def q_scan_catalog_table(spark, sf):
    """A stored table by catalog name, partitioned by month."""
    name = f"sales_{uuid.uuid4().hex}"
    log = bulk_log(spark, sf)
    (log.repartitionByRange("month_num", "sale_date", "item_id").write.partitionBy("month_num")
     .option("path", scratch(spark, name)).saveAsTable(name))
    return files.load(spark, name)


@register("rename_if_present", WD + "\nSELECT * FROM daily_log")
def q_rename(spark, sf):
    """Legacy column names (``date`` as text, ``date_block_num``)."""
    legacy = daily_log(spark, sf).select(
        D.format_date("sale_date").alias("date"), F.col("month_num").alias("date_block_num"),
        "shop_id", "item_id", "item_price", "item_cnt_day")
    return files.to_sales_log(legacy)


@register("union_daily", WD + "\nSELECT * FROM daily_log")
def q_union(spark, sf):
    """Daily frames concatenated by name (UNION ALL)."""
    log = daily_log(spark, sf)
    last = max_date(log)
    older = log.filter(F.col("sale_date") < last)
    newest = log.filter(F.col("sale_date") >= last).select(*reversed(log.columns))
    return older.unionByName(newest)


@register("derive_total_sale", WB + """
SELECT *, CAST(CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4)) AS DOUBLE)
          AS total_sale
FROM bulk_sales""")
def q_total_sale(spark, sf):
    """P1 + X4: the amount of every sale row."""
    from ledgerlens.functions.numeric import amount_to_double, line_total
    s = positive_sales(bulk_log(spark, sf))
    return s.withColumn("total_sale", amount_to_double(line_total("item_price", "item_cnt_day")))


@register("join_items", WD + """
SELECT s.*, i.item_name, i.item_category_id
FROM daily_log s JOIN daily_items i ON s.item_id = i.item_id""")
def q_join_items(spark, sf):
    """Sales rows with item attributes (broadcast after a size check)."""
    from ledgerlens.operators.joins import join_items
    log, items, _ = daily_model(spark, sf)
    return join_items(log, items)


@register("join_day_over_day", WD + """,
s1 AS (SELECT item_id, sum(item_cnt_day) AS last_total FROM daily_log
       WHERE sale_date = (SELECT max(sale_date) FROM daily_log) GROUP BY item_id),
s2 AS (SELECT item_id, sum(item_cnt_day) AS prev_total FROM daily_log
       WHERE sale_date + 1 = (SELECT max(sale_date) FROM daily_log) GROUP BY item_id)
SELECT (SELECT max(sale_date) FROM daily_log) AS sale_date, s1.item_id, last_total, prev_total
FROM s1 JOIN s2 ON s1.item_id = s2.item_id""")
def q_dod(spark, sf):
    """Units on the latest day next to the day before, per item."""
    return reports.day_over_day(daily_log(spark, sf))


@register("units_by_category", WB + """
SELECT c.item_category_id, c.item_category_name, sum(s.item_cnt_day) AS sales_sum
FROM bulk_sales s JOIN bulk_items i ON s.item_id = i.item_id
JOIN bulk_categories c ON c.item_category_id = i.item_category_id
GROUP BY c.item_category_id, c.item_category_name""")
def q_units_category(spark, sf):
    """Units per category (aggregated per item before the joins)."""
    per_item = A.units_by(positive_sales(bulk_log(spark, sf)), "item_id")
    star = join_star(per_item, bulk_items(spark, sf), bulk_categories(spark, sf))
    return star.groupBy("item_category_id", "item_category_name").agg(
        F.sum("item_cnt_day").alias("sales_sum"))




def _classes_sql():
    from ledgerlens.plans.queries_classes import _CLASSES_ITEM
    return _CLASSES_ITEM


@register("count_by_class_pair", _classes_sql() + """
SELECT abc, xyz, count(*) AS count FROM classes GROUP BY abc, xyz""")
def q_count_pairs(spark, sf):
    """Items per (abc, xyz) pair, only pairs that occur."""
    classes = C.abc_xyz(positive_sales(bulk_log(spark, sf)))
    return classes.groupBy("abc", "xyz").agg(F.count(F.lit(1)).alias("count"))


@register("filter_class_pair", _classes_sql() + "\nSELECT * FROM classes WHERE abc = 'B' AND xyz = 'Z'")
def q_class_pair(spark, sf):
    """items of one class pair."""
    from ledgerlens.operators.filters import class_pair
    return class_pair(C.abc_xyz(positive_sales(bulk_log(spark, sf))), "B", "Z")


@register("filter_share_band", WB + """,
t AS (SELECT item_id, sum(item_cnt_day) AS item_cnt_day FROM bulk_sales GROUP BY item_id),
r AS (SELECT item_id, item_cnt_day, sum(item_cnt_day) OVER (ORDER BY item_cnt_day DESC) AS cumsum FROM t),
p AS (SELECT item_id, item_cnt_day, cumsum,
             round(cumsum / (SELECT sum(item_cnt_day) FROM t), 3) AS percentage FROM r)
SELECT *, 'B' AS abc FROM p WHERE percentage > 0.6 AND percentage <= 0.8""")
def q_share_band(spark, sf):
    """items whose running share lies in (0.6, 0.8]."""
    from ledgerlens.operators.filters import share_band
    return share_band(C.abc_analysis(positive_sales(bulk_log(spark, sf))), 0.6, 0.8)


@register("filter_in_top_categories", WB + """,
per_item AS (SELECT item_id, sum(item_cnt_day) AS u FROM bulk_sales GROUP BY item_id),
top5 AS (SELECT c.item_category_id, c.item_category_name, sum(p.u) AS sales_sum
         FROM per_item p JOIN bulk_items i ON p.item_id = i.item_id
         JOIN bulk_categories c ON c.item_category_id = i.item_category_id
         GROUP BY c.item_category_id, c.item_category_name
         ORDER BY sales_sum DESC, c.item_category_id LIMIT 5)
SELECT s.* FROM bulk_sales s JOIN bulk_items i ON s.item_id = i.item_id
WHERE i.item_category_id IN (SELECT item_category_id FROM top5)""")
def q_in_top(spark, sf):
    """sale rows of the top-5 categories (a semi-join, no driver list)."""
    from ledgerlens.plans.calendar import in_top_categories
    s = positive_sales(bulk_log(spark, sf))
    return in_top_categories(s, bulk_items(spark, sf), bulk_categories(spark, sf))


@register("sort_by_variation", WB + """,
per AS (SELECT month_num, item_id, sum(item_cnt_day) AS m FROM bulk_sales GROUP BY month_num, item_id),
st AS (SELECT item_id, round(stddev_pop(m) / nullif(avg(m), 0), 3) AS var_coeff FROM per GROUP BY item_id)
SELECT CAST(row_number() OVER (ORDER BY var_coeff DESC NULLS LAST, item_id) - 1 AS BIGINT) AS index,
       item_id, var_coeff FROM st""")
def q_sort_cv(spark, sf):
    """Items by variation coefficient, numerically descending, with the
    position as a column so the order is part of the result. Every item is
    ranked, so the position comes from the distributed index, not a window."""
    from ledgerlens.operators.running import ordered_index
    x = C.xyz_analysis(positive_sales(bulk_log(spark, sf))).select("item_id", "var_coeff")
    return ordered_index(x, "var_coeff", "item_id").select("index", "item_id", "var_coeff")


@register("format_functions", WB + """,
d AS (SELECT sale_date, CAST(sum(CAST(item_price AS DECIMAL(18,6)) * CAST(item_cnt_day AS DECIMAL(18,4)))
                             AS DOUBLE) AS total_daily_sale
      FROM bulk_sales GROUP BY sale_date),
t AS (SELECT sum(total_daily_sale) AS total FROM d)
SELECT sale_date, printf('%.3f%%', total_daily_sale / (SELECT total FROM t) * 100) AS share_text,
       format('{:,.0f}', total_daily_sale / 1000000.0) || 'M' AS sale_label
FROM d""")
def q_format(spark, sf):
    """Text labels for reports (millions, percent of total)."""
    from ledgerlens.functions.numeric import format_millions, format_percent
    from ledgerlens.plans.calendar import daily_revenue
    d = daily_revenue(positive_sales(bulk_log(spark, sf)))
    total = d.select(F.sum("total_daily_sale")).scalar()
    return d.select("sale_date", format_percent(F.col("total_daily_sale") / total).alias("share_text"),
                    format_millions("total_daily_sale").alias("sale_label"))


@register("daily_pipeline", WD + """
SELECT c.item_category_id, c.item_category_name,
       sum(s.item_cnt_day) AS num_sold,
       CAST(sum(CAST(s.item_price AS DECIMAL(18,6)) * CAST(s.item_cnt_day AS DECIMAL(18,4))) AS DOUBLE) AS sales
FROM daily_log s
JOIN daily_items i ON s.item_id = i.item_id
JOIN daily_categories c ON c.item_category_id = i.item_category_id
WHERE s.sale_date IN (SELECT max(sale_date) FROM daily_log)
GROUP BY c.item_category_id, c.item_category_name""")
def q_pipeline(spark, sf):
    """Ingest the landing files, then run the reports on the
    month-partitioned table (report 1 returned; all four are built)."""
    from ledgerlens.streaming.ingest import daily_pipeline
    log, items, cats = daily_model(spark, sf)
    drop = scratch(spark, "drop")
    sinks.sales_log_to_csv(log, drop)
    out = daily_pipeline(spark, drop, scratch(spark, "table"), scratch(spark, "ckpt"),
                         items, cats, report_dir=scratch(spark, "reports"))
    return out["by_category"]


# ------------------------------------------------- order of any type, NULLs
_TYPED = """
typed_orders AS (
  SELECT o_orderkey AS k,
         CASE WHEN o_orderkey % 19 <> 0 THEN 9007199254740992 + o_orderkey % 7 END AS big,
         CASE WHEN o_orderkey % 23 <> 0
              THEN concat('item-000000-', o_orderkey % 1009, '-', o_orderkey) END AS label,
         CASE WHEN o_orderkey % 29 <> 0
              THEN CAST(o_totalprice AS DECIMAL(30,2)) + CAST(10000000000000000000 AS DECIMAL(30,2)) END AS amount
  FROM orders)"""


def _typed_orders(spark, sf):
    orders = spark.read.parquet(os.path.join(sf, "orders.parquet"))
    return spark.sql("WITH" + _TYPED.replace("FROM orders", "FROM {orders}")
                     + " SELECT * FROM typed_orders", orders=orders)


def _index_sql(order):
    return ("WITH" + _TYPED + f"""
SELECT CAST(row_number() OVER (ORDER BY {order} NULLS LAST, k) - 1 AS BIGINT) AS index, k, {order.split()[0]}
FROM typed_orders""")


@register("index_by_bigint", _index_sql("big DESC"))
def q_index_bigint(spark, sf):
    """Positions by whole numbers that doubles cannot tell apart, with NULLs."""
    from ledgerlens.operators.running import ordered_index
    return ordered_index(_typed_orders(spark, sf).select("k", "big"), "big", "k").select("index", "k", "big")


@register("index_by_text", _index_sql("label ASC"))
def q_index_text(spark, sf):
    """Positions by texts that begin alike, with NULLs."""
    from ledgerlens.operators.running import ordered_index
    return ordered_index(_typed_orders(spark, sf).select("k", "label"), "label", "k",
                         descending=False).select("index", "k", "label")


@register("indexed_decimal_report", "WITH" + _TYPED + """
SELECT CAST(row_number() OVER (ORDER BY amount DESC NULLS LAST, k) - 1 AS INTEGER) AS index,
       CAST(k AS VARCHAR) AS k, CAST(amount AS VARCHAR) AS amount FROM typed_orders""")
def q_index_report(spark, sf):
    """K2: an indexed report ordered by wide decimals, read back from its files."""
    path = scratch(spark, "indexed-decimals")
    sinks.write_indexed_report(_typed_orders(spark, sf).select("k", "amount"), path, "amount", "k")
    return spark.read.option("header", "true").csv(path).select(
        F.col("index").cast("int").alias("index"), "k", "amount")


@register("position_by_text_in_group", "WITH" + _TYPED + """
SELECT big, k, label, row_number() OVER (PARTITION BY big ORDER BY label, k) AS position
FROM typed_orders WHERE label IS NOT NULL""")
def q_position_text(spark, sf):
    """Positions inside groups (one of them NULL) by text."""
    from ledgerlens.operators.running import position_within
    rows = _typed_orders(spark, sf).filter("label IS NOT NULL").select("big", "k", "label")
    return position_within(rows, ["big"], "label")


# ------------------------------------------------------ upkeep of the table
_REJECTED = """
SELECT CASE user_id % 50 WHEN 1 THEN 'value' WHEN 2 THEN 'date' WHEN 3 THEN 'fields' ELSE 'taken' END
         AS outcome, count(*) AS n_rows
FROM events GROUP BY 1"""


@register("ingest_rejects", _REJECTED)
def q_rejects(spark, sf):
    """Landing rows with a bad number, a bad date or too few fields go
    to the rejects table; counted there and in the sales table."""
    drop, table, rejects = (scratch(spark, n) for n in ("bad-drop", "bad-table", "rejects"))
    case = F.col("item_id") % 50
    texts = daily_log(spark, sf).select(
        F.when(case == 2, F.lit("31.02.2013")).otherwise(D.format_date("sale_date")).alias("sale_date"),
        "month_num", "shop_id", "item_id",
        F.when(case == 1, F.lit("n/a")).otherwise(F.col("item_price").cast("string")).alias("item_price"),
        "item_cnt_day")
    (texts.filter(case != 3).write.option("header", "true").csv(f"{drop}/whole"))
    (texts.filter(case == 3).drop("item_price", "item_cnt_day")
     .write.option("header", "true").csv(f"{drop}/short"))
    ingest_available(spark, f"{drop}/*", table, scratch(spark, "bad-ckpt"), rejects_dir=rejects)
    bad = spark.read.parquet(rejects).select(F.col("reason").alias("outcome"))
    good = files.read_sales_table(spark, table).select(F.lit("taken").alias("outcome"))
    return bad.unionByName(good).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


@register("compacted_table", WD + "\nSELECT * FROM daily_log")
def q_compacted(spark, sf):
    """A back-fill and four daily loads, closed months compacted and
    cleaned, one more load on top."""
    from ledgerlens.sources import ledger
    log, table = daily_log(spark, sf), scratch(spark, "compacted")
    last = log.select(F.max("sale_date")).scalar()
    day = F.datediff(last, "sale_date")
    sinks.write_sales_log(log.filter(day > 40), table)
    for newest, oldest in ((30, 40), (20, 29), (10, 19), (1, 9)):
        sinks.append_sales(log.filter(day.between(newest, oldest)), table)
    ledger.compact(spark, table)
    ledger.vacuum(spark, table)
    sinks.append_sales(log.filter(day == 0), table)
    return files.read_sales_table(spark, table)


@register("latest_day_wrong_month", WD + """
SELECT item_id, sum(item_cnt_day) AS units FROM daily_log
WHERE sale_date = (SELECT max(sale_date) FROM daily_log) GROUP BY item_id""")
def q_wrong_month(spark, sf):
    """The latest day of a table in which a third of its rows name a month
    of long ago; only months whose dates can hold it are read."""
    from ledgerlens.sources import ledger
    table = scratch(spark, "wrong-months")
    month = F.when(F.col("item_id") % 3 == 0, F.col("month_num") - 30).otherwise(F.col("month_num"))
    sinks.write_sales_log(daily_log(spark, sf).withColumn("month_num", month), table)
    day = latest_day(ledger.read_latest_days(spark, table))
    return day.groupBy("item_id").agg(F.sum("item_cnt_day").alias("units"))
