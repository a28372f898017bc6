"""Registered queries: the four daily reports (R1-R4) on mapping B."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog import register
from ledgerlens.plans import reports
from ledgerlens.session import scratch
from ledgerlens.sources import files, sinks
from ledgerlens.sources.fixtures import DAILY_CTE, daily_model
from ledgerlens.sources.publication import publish, published
from ledgerlens.streaming.ingest import daily_pipeline

W = "WITH " + DAILY_CTE

_LAST = "(SELECT max(sale_date) FROM daily_log)"


@register("report_by_category", W + f"""
SELECT c.item_category_id, c.item_category_name,
       sum(s.item_cnt_day) AS num_sold,
       CAST(sum(CAST(s.item_price AS DECIMAL(18,6)) * CAST(s.item_cnt_day AS DECIMAL(18,4))) AS DOUBLE) AS sales
FROM daily_log s
JOIN daily_items i ON s.item_id = i.item_id
JOIN daily_categories c ON c.item_category_id = i.item_category_id
WHERE s.sale_date IN {_LAST}
GROUP BY c.item_category_id, c.item_category_name
ORDER BY sales""")
def q_report_by_category(spark, sf):
    return reports.report_by_category(*daily_model(spark, sf))


@register("report_top_goods", W + f"""
SELECT s.item_id, i.item_name, count(s.item_cnt_day) AS daily_count
FROM daily_log s JOIN daily_items i ON s.item_id = i.item_id
WHERE s.sale_date IN {_LAST}
GROUP BY s.item_id, i.item_name
ORDER BY daily_count DESC, s.item_id LIMIT 10""")
def q_report_top_goods(spark, sf):
    log, items, _ = daily_model(spark, sf)
    return reports.report_top_goods(log, items)


@register("report_top_goods_sale", W + f"""
SELECT item_id, item_name, CAST(sum(item_price::DECIMAL(18,6)
                                    * item_cnt_day::DECIMAL(18,4)) AS DOUBLE) AS sale
FROM daily_log JOIN daily_items USING (item_id)
WHERE sale_date = {_LAST}
GROUP BY ALL ORDER BY sale DESC, item_id LIMIT 10""")
def q_report_top_goods_sale(spark, sf):
    log, items, _ = daily_model(spark, sf)
    return reports.report_top_goods_sale(log, items)


_DIFF_SQL = W + f""",
changes AS (
  SELECT item_id, sum(CASE WHEN sale_date = {_LAST} THEN item_cnt_day ELSE -item_cnt_day END) AS change,
         count(DISTINCT sale_date) AS days
  FROM daily_log WHERE sale_date BETWEEN {_LAST} - 1 AND {_LAST} GROUP BY item_id)
SELECT {_LAST} AS sale_date, item_id, item_name, abs(change) AS difference
FROM changes JOIN daily_items USING (item_id) WHERE days = 2
ORDER BY difference DESC, item_id LIMIT 10"""


@register("report_top_difference", _DIFF_SQL)
def q_report_top_difference(spark, sf):
    log, items, _ = daily_model(spark, sf)
    return reports.report_top_difference(log, items)


@register("report_top_difference_outer", _DIFF_SQL.replace(" WHERE days = 2", ""))
def q_report_top_difference_outer(spark, sf):
    log, items, _ = daily_model(spark, sf)
    return reports.report_top_difference(log, items, how="outer")


# The report files with their columns (key, name, value).
_REPORT_FILES = {
    "by_category": ("report_by_category", "item_category_id int, item_category_name string, num_sold double, "
                    "sales double", ("item_category_id", "item_category_name", "sales")),
    "top_goods": ("report_top_goods", "item_id long, item_name string, daily_count long",
                  ("item_id", "item_name", "daily_count")),
    "top_goods_sale": ("report_top_goods_sale", "item_id long, item_name string, sale double",
                       ("item_id", "item_name", "sale")),
    "top_difference": ("report_top_difference", "sale_date date, item_id long, item_name string, "
                       "difference double", ("item_id", "item_name", "difference")),
}


def _daily_run_sql():
    from ledgerlens.catalog import _ORACLES
    return " UNION ALL ".join(
        f"SELECT '{name}' AS report, CAST({key} AS BIGINT) AS id, {label} AS name, "
        f"CAST({value} AS DOUBLE) AS value FROM ({_ORACLES[query]})"
        for name, (query, _, (key, label, value)) in _REPORT_FILES.items())


@register("daily_pipeline_reports", _daily_run_sql())
def q_daily_run(spark, sf):
    """R15 + K3: the daily run on two arrivals (the last day comes second),
    then the four report files of the second run, read back."""
    log, items, categories = daily_model(spark, sf)
    drop, table, ckpt, out = (scratch(spark, n) for n in ("run-drop", "run-table", "run-ckpt", "run-out"))
    last = log.select(F.max("sale_date")).scalar()
    for arrival, rows in (("before", F.col("sale_date") < last), ("last", F.col("sale_date") == last)):
        sinks.sales_log_to_csv(log.filter(rows), f"{drop}/{arrival}")
        daily_pipeline(spark, f"{drop}/*", table, ckpt, items, categories, report_dir=out)
    return _report_rows(spark, {name: f"{out}/{name}" for name in _REPORT_FILES})


def _report_rows(spark, paths):
    """The four report files, read back as one table."""
    parts = []
    for name, (_, schema, (key, label, value)) in _REPORT_FILES.items():
        parts.append(files.read_dim_csv(spark, paths[name], schema).select(
            F.lit(name).alias("report"), F.col(key).cast("long").alias("id"),
            F.col(label).alias("name"), F.col(value).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


@register("published_reports", _daily_run_sql())
def q_published(spark, sf):
    """K3: the four reports as published after two arrivals; a third run that
    dies after its first report changes nothing for readers."""
    log, items, categories = daily_model(spark, sf)
    drop, table, ckpt, out = (scratch(spark, n) for n in ("pub-drop", "pub-table", "pub-ckpt", "pub-out"))
    last = log.select(F.max("sale_date")).scalar()
    for arrival, rows in (("before", F.col("sale_date") < last), ("last", F.col("sale_date") == last)):
        sinks.sales_log_to_csv(log.filter(rows), f"{drop}/{arrival}")
        result = daily_pipeline(spark, f"{drop}/*", table, ckpt, items, categories, publish_dir=out)

    def dies(path):
        raise InterruptedError(path)

    try:
        publish(spark, out, {"by_category": lambda path: sinks.write_report(
            result["by_category"].limit(0), path), "top_goods": dies})
    except InterruptedError:
        pass
    return _report_rows(spark, published(spark, out))


def _sql_report(name):
    def run(spark, sf):
        reports.register_model(spark, *daily_model(spark, sf))
        return reports.run_report_sql(spark, name)
    return run


# The Spark SQL texts of the reports (one pass of conditional sums) against the
# same oracles: they must agree with the DataFrame form.
def _register_sql_forms():
    from ledgerlens.catalog import _ORACLES
    for df_name, sql_name in [("report_by_category", "by_category"),
                              ("report_top_goods", "top_goods"),
                              ("report_top_goods_sale", "top_goods_sale"),
                              ("report_top_difference", "top_difference")]:
        register(df_name + "_sql", _ORACLES[df_name])(_sql_report(sql_name))


_register_sql_forms()
