"""Command-line jobs: what a scheduler runs.

    python -m ledgerlens.jobs ingest   --drop DIR --table DIR [--archive DIR] [--checkpoint DIR]
                                       [--rejects DIR]
    python -m ledgerlens.jobs compact  --table DIR
    python -m ledgerlens.jobs reports  --table DIR --items PATH --categories PATH --out DIR
                                       [--publish]
    python -m ledgerlens.jobs analysis --table DIR --items PATH --categories PATH --out DIR
                                       [--publish] [--store DIR]

``ingest`` loads new daily files into the month-partitioned table (S6), ``compact``
merges the loads of its closed months (run it when no ingestion runs),
``reports`` writes the four latest-day reports (R1-R4) as CSV files, and
``analysis`` writes the classification, price and calendar tables (R7-R14).
Dimension paths ending in ``.csv`` are read as quoted CSV, others as Parquet.

With ``--publish`` the outputs of a run appear together, when all are written
(:mod:`ledgerlens.sources.publication`); without it each is overwritten in place.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.aggregates import class_share
from ledgerlens.operators.filters import positive_sales
from ledgerlens.plans import calendar as K
from ledgerlens.plans import classification as C
from ledgerlens.plans import partials
from ledgerlens.plans import prices as P
from ledgerlens.plans import reports as R
from ledgerlens.schema import CATEGORIES_SCHEMA, ITEMS_SCHEMA
from ledgerlens.session import build_session, materialize, remove_scratch
from ledgerlens.sources import files, sinks
from ledgerlens.sources.ledger import compact, read_latest_days, vacuum
from ledgerlens.sources.publication import publish, vacuum_runs
from ledgerlens.streaming.ingest import ingest_available

# The class pairs whose top sellers the analysis reports.
REPORTED_CLASS_PAIRS = (("A", "X"), ("B", "X"), ("C", "X"), ("C", "Z"))


# Outputs written with a row index: order column, tie column, descending.
INDEXED = {
    "mean_product_prices_sorted": ("mean_price", "item_id", True),
    "mean_product_price_outliers": ("mean_price", "item_id", True),
    "mean_price_for_category": ("mean_price", "item_category_id", True),
    "mean_category_prices_top_5": ("mean_price", "item_id", True),
    "total_price_to_date": ("sale_date", "month_num", False),
}
# Outputs that grow with the items or days and carry no index.
AS_TABLE = ("abc_xyz", "mean_product_prices_trimmed", "mean_category_prices_top_5_trimmed",
            "category_sales_calendar", "product_price_histogram")


def _dimension(spark: SparkSession, path: str, schema) -> DataFrame:
    if path.endswith(".csv"):
        return files.read_dim_csv(spark, path, schema)
    return spark.read.parquet(path).select(*schema.fieldNames())


def run_ingest(spark: SparkSession, drop: str, table: str, archive: str | None = None,
               checkpoint: str | None = None, rejects: str | None = None) -> dict[str, int]:
    """The checkpoint must stay the same from run to run (it records which
    files were loaded); by default it lives inside the table folder, in a
    folder that readers skip."""
    checkpoint = checkpoint or os.path.join(table, "_ingest_checkpoint")
    return ingest_available(spark, drop, table, checkpoint, archive, rejects)


def run_compact(spark: SparkSession, table: str) -> str | None:
    """Closed months as one load each; the loads replaced by an earlier run are
    deleted first, so a reader has one run's time to finish."""
    vacuum(spark, table)
    return compact(spark, table)


def _write_outputs(spark: SparkSession, out: str, writers: dict[str, Callable[[str], object]],
                   together: bool) -> None:
    """Each output into its folder below ``out``, or all as one published set."""
    if together:
        publish(spark, out, writers)
        vacuum_runs(spark, out)
        return
    for name, write in writers.items():
        write(os.path.join(out, name))


def _output_writer(name: str, df: DataFrame) -> Callable[[str], object]:
    """Per-item and per-day outputs are written in parallel; small results as
    one CSV file each."""
    if name.startswith("top_10_products"):
        return lambda path: sinks.write_indexed_report(df, path, "total_sale", "item_id")
    if name in INDEXED:
        return lambda path: sinks.write_indexed_report(df, path, *INDEXED[name])
    if name in AS_TABLE:
        return lambda path: df.write.mode("overwrite").parquet(path)
    return partial(sinks.write_report, df)


def run_reports(spark: SparkSession, table: str, items: DataFrame, categories: DataFrame,
                out: str, together: bool = False) -> dict[str, DataFrame]:
    """R1-R4 on the partitioned table (reads only the months whose dates can
    hold the last two days). ``together``: published as one set."""
    log = read_latest_days(spark, table)
    result = {
        "by_category_report": R.report_by_category(log, items, categories),
        "top_10_goods": R.report_top_goods(log, items),
        "top_10_goods_sale": R.report_top_goods_sale(log, items),
        "top_10_difference": R.report_top_difference(log, items),
    }
    _write_outputs(spark, out, {n: _output_writer(n, df) for n, df in result.items()}, together)
    return result


def run_analysis(spark: SparkSession, table: str, items: DataFrame, categories: DataFrame,
                 out: str, store: str | None = None,
                 together: bool = False) -> dict[str, DataFrame]:
    """R7-R14 on positive sales; small results as (indexed) CSV files, with
    ``together`` published as one set.

    The log is read four times: per (month, item), per item, per day and per
    (day, category); everything else derives from these written tables. With
    ``store`` (a folder that stays from run to run) the sums of earlier loads
    are kept there and only new loads are read.
    """
    if store:
        partials.update(spark, table, store)
        totals = partials.read(spark, table, store)
        per, summary = partials.period_totals(totals), partials.item_summary(totals)
        daily = partials.daily_table(totals)
        cat_daily = partials.category_daily(totals, items, categories)
    else:
        sales = positive_sales(files.read_sales_table(spark, table))
        per, summary = C.period_totals(sales, with_revenue=True), P.item_summary(sales)
        daily = K.daily_table(sales)
        cat_daily = K.category_daily(sales, items, categories)
    cat_daily = materialize(cat_daily)
    classes = materialize(C.abc_xyz(None, per=per))
    revenue = C.revenue_from_periods(per)
    item_prices = materialize(P.mean_product_prices(None, items, summary))
    cat_prices = materialize(P.mean_category_prices(None, items, categories, summary))
    top_cat_items = materialize(P.top_category_item_prices(None, items, categories, summary=summary))
    result = {
        "abc_xyz": classes,
        "abc_xyz_grid": C.abc_xyz_grid(classes),
        "abc_share": class_share(classes),
        "mean_product_prices_sorted": item_prices,
        "mean_product_prices_trimmed": P.trimmed_prices(item_prices),
        "mean_product_price_outliers": P.price_outliers(item_prices),
        "describe_trimmed_prices": P.describe_trimmed_prices(item_prices),
        "product_price_histogram": P.item_price_histogram(item_prices),
        "product_price_histogram_auto": P.item_price_histogram_auto(item_prices),
        "mean_price_for_category": cat_prices,
        "category_price_histogram": P.category_price_histogram(cat_prices),
        "mean_category_prices_top_5": top_cat_items,
        "mean_category_prices_top_5_trimmed": P.top_category_trimmed(top_cat_items),
        "describe_category_prices": P.describe_category_prices(top_cat_items),
        "category_price_density": P.category_price_density(top_cat_items),
        "total_price_to_date": daily.select("sale_date", "month_num", K.DAY),
        "weekly_sales": K.weekly_of_daily(daily),
        "monthly_sales": K.monthly_of_daily(daily),
        "category_sales_calendar": K.calendar_of_daily(cat_daily, *K.CATEGORY_KEYS),
        "category_weekly_sales": K.weekly_of_daily(cat_daily, *K.CATEGORY_KEYS),
    }
    for a, x in REPORTED_CLASS_PAIRS:
        result[f"top_10_products_by_sale_in_{a.lower()}{x.lower()}"] = C.top_sales_in_class(
            classes, None, items, a, x, revenue=revenue)
    for kind in K.SEASONAL:
        result[f"sales_by_{kind}"] = K.seasonal_of_daily(daily, kind)
        result[f"category_sales_by_{kind}"] = K.seasonal_of_daily(cat_daily, kind,
                                                                  "item_category_name")
    _write_outputs(spark, out, {n: _output_writer(n, df) for n, df in result.items()}, together)
    return result


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="ledgerlens.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    ing = sub.add_parser("ingest")
    ing.add_argument("--drop", required=True)
    ing.add_argument("--table", required=True)
    ing.add_argument("--archive")
    ing.add_argument("--checkpoint")
    ing.add_argument("--rejects")
    sub.add_parser("compact").add_argument("--table", required=True)
    for name in ("reports", "analysis"):
        p = sub.add_parser(name)
        p.add_argument("--table", required=True)
        p.add_argument("--items", required=True)
        p.add_argument("--categories", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--publish", action="store_true")
        if name == "analysis":
            p.add_argument("--store")
    args = ap.parse_args(argv)
    spark = build_session(app_name=f"ledgerlens-{args.job}")
    if args.job == "ingest":
        print(run_ingest(spark, args.drop, args.table, args.archive, args.checkpoint, args.rejects))
        return
    if args.job == "compact":
        run_compact(spark, args.table)
        return
    items = _dimension(spark, args.items, ITEMS_SCHEMA)
    categories = _dimension(spark, args.categories, CATEGORIES_SCHEMA)
    if args.job == "reports":
        run_reports(spark, args.table, items, categories, args.out, args.publish)
    else:
        run_analysis(spark, args.table, items, categories, args.out, args.store, args.publish)
    remove_scratch(spark)


if __name__ == "__main__":
    main()
