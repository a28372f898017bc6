"""Checks on physical plans: the shapes the design relies on."""

import contextlib
import io
import os

from builders import make_categories, make_items, make_log

from ledgerlens.session import materialize
from ledgerlens.plans import reports
from ledgerlens.sources import files, sinks


def _plan(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _table(spark, tmp_dir):
    rows = [(f"2014-{m:02d}-{d:02d}", i, 5.0, 1) for m in (10, 11, 12) for d in (1, 15, 28)
            for i in range(1, 4)]
    path = os.path.join(tmp_dir, "sales")
    sinks.write_sales_log(make_log(spark, rows), path)
    return files.read_sales_table(spark, path)


def test_reports_prune_month_partitions_and_broadcast_dimensions(spark, tmp_dir):
    log = _table(spark, tmp_dir)
    items = make_items(spark, [(i, f"n{i}", 1) for i in range(1, 4)])
    cats = make_categories(spark, [(1, "one")])
    # Stored tables, as dimensions are: their size is known from the files.
    items, cats = materialize(items), materialize(cats)
    plan = _plan(reports.report_by_category(log, items, cats, month_col="month_num"))
    assert "PartitionFilters: [isnotnull(month_num" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    diff = _plan(reports.report_top_difference(log, items, month_col="month_num"))
    assert "PartitionFilters: [isnotnull(month_num" in diff
    assert "TakeOrderedAndProject" in diff


def test_positive_sales_filter_reaches_the_scan(spark, tmp_dir):
    from ledgerlens.operators.filters import positive_sales
    plan = _plan(positive_sales(_table(spark, tmp_dir)).groupBy("item_id").count())
    assert "PushedFilters: [IsNotNull(item_cnt_day), GreaterThan(item_cnt_day,0.0)]" in plan


def test_running_total_has_no_global_window_over_keys(spark):
    from ledgerlens.operators.running import running_total
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(500)], "item_id long, units double")
    plan = _plan(running_total(df, "units", "item_id", frame="rows", buckets=8))
    # Every window that orders keys or units has a PARTITION BY (its first
    # spec element carries no sort direction); only the offset window over
    # the <= 8 range rows is global.
    specs = [line.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe")[0]
             for line in plan.splitlines()
             if line.startswith("Arguments: [") and "windowspecdefinition" in line]
    over_keys = [sp for sp in specs if "item_id" in sp or "units" in sp]
    assert over_keys
    for sp in over_keys:
        first = sp.split(",")[0]
        assert "ASC" not in first and "DESC" not in first, sp
    assert all(sp.startswith("_lr_bucket") or sp.startswith("_pw_bucket")
               for sp in specs if sp not in over_keys), specs


def test_price_statistics_read_the_log_once(spark, tmp_dir):
    from ledgerlens.plans import prices as P
    log = _table(spark, tmp_dir)
    items = materialize(make_items(spark, [(i, f"n{i}", 1) for i in range(1, 4)]))
    for analysis in (P.describe_trimmed_prices, P.item_price_histogram_auto,
                     P.item_price_histogram):
        plan = analysis(P.mean_product_prices(log, items))._jdf.queryExecution().toString()
        assert tmp_dir not in plan


def test_remove_scratch_deletes_this_applications_tables(spark):
    from ledgerlens.session import remove_scratch, scratch_root
    assert materialize(spark.range(3)).count() == 3
    assert os.path.exists(scratch_root(spark))
    remove_scratch(spark)
    assert not os.path.exists(scratch_root(spark))
