import os

from builders import make_categories, make_items, make_log

from ledgerlens import jobs
from ledgerlens.sources import sinks


def _setup(spark, tmp_dir):
    rows = []
    for day in range(1, 29):
        for item in range(1, 7):
            if (day + item) % 3:
                rows.append((f"2014-{1 + day % 2:02d}-{day:02d}", item, 10.0 * item, 1 + item % 2))
    rows.append(("2014-02-28", 1, 10.0, -1))
    table = os.path.join(tmp_dir, "table")
    sinks.write_sales_log(make_log(spark, rows), table)
    items = make_items(spark, [(i, f"item {i}", i % 2) for i in range(1, 7)])
    cats = make_categories(spark, [(0, "even"), (1, "odd")])
    return table, items, cats


def test_reports_job_writes_four_csv_reports(spark, tmp_dir):
    table, items, cats = _setup(spark, tmp_dir)
    out = os.path.join(tmp_dir, "out")
    res = jobs.run_reports(spark, table, items, cats, out)
    assert sorted(os.listdir(out)) == sorted(res)
    back = spark.read.option("header", True).csv(os.path.join(out, "by_category_report"))
    assert back.count() == res["by_category_report"].count() > 0


def test_analysis_job_writes_tables(spark, tmp_dir):
    table, items, cats = _setup(spark, tmp_dir)
    out = os.path.join(tmp_dir, "out")
    res = jobs.run_analysis(spark, table, items, cats, out)
    assert set(os.listdir(out)) == set(res)
    grid = spark.read.option("header", True).csv(os.path.join(out, "abc_xyz_grid"))
    assert grid.count() == 9
    assert spark.read.parquet(os.path.join(out, "abc_xyz")).count() == 6


def test_ingest_job_default_checkpoint_is_stable(spark, tmp_dir):
    drop, table = os.path.join(tmp_dir, "drop"), os.path.join(tmp_dir, "table")
    os.makedirs(drop)
    with open(os.path.join(drop, "d1.csv"), "w") as fh:
        fh.write("sale_date,month_num,shop_id,item_id,item_price,item_cnt_day\n"
                 "31.12.2014,23,0,1,10,1\n")
    jobs.run_ingest(spark, drop, table)
    jobs.run_ingest(spark, drop, table)
    from ledgerlens.sources.files import read_sales_table
    assert read_sales_table(spark, table).count() == 1


def _sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_analysis_from_kept_totals_reads_only_new_loads(spark, tmp_dir):
    from ledgerlens.plans import partials
    from ledgerlens.sources import ledger
    table, items, cats = _setup(spark, tmp_dir)
    store = os.path.join(tmp_dir, "store")
    assert partials.update(spark, table, store) == 2  # two months of one load
    day = make_log(spark, [("2014-02-28", i, 7.0, 2) for i in range(1, 5)] + [("2014-02-28", 2, 1.0, -1)])
    sinks.append_sales(day, table)
    assert partials.update(spark, table, store) == 1
    assert partials.update(spark, table, store) == 0
    kept = jobs.run_analysis(spark, table, items, cats, os.path.join(tmp_dir, "a"), store)
    full = jobs.run_analysis(spark, table, items, cats, os.path.join(tmp_dir, "b"))
    assert kept.keys() == full.keys()
    for name in full:
        assert _sorted_rows(kept[name]) == _sorted_rows(full[name]), name
    # A compaction takes over the totals; nothing is read again.
    assert ledger.compact(spark, table, keep_open=0)
    ledger.vacuum(spark, table)
    assert partials.update(spark, table, store) == 0
    from ledgerlens.plans import classification as C
    from ledgerlens.operators.filters import positive_sales
    from ledgerlens.sources.files import read_sales_table
    whole = C.period_totals(positive_sales(read_sales_table(spark, table)), with_revenue=True)
    assert _sorted_rows(partials.period_totals(partials.read(spark, table, store))) == _sorted_rows(whole)


def test_a_load_without_positive_sales_is_done(spark, tmp_dir):
    from ledgerlens.plans import partials
    table, store = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "s")
    sinks.write_sales_log(make_log(spark, [("2014-01-01", 1, 5.0, -1)]), table)
    assert partials.update(spark, table, store) == 1
    assert partials.update(spark, table, store) == 0
    assert partials.read(spark, table, store).count() == 0


def test_daily_series_is_indexed_by_date(spark, tmp_dir):
    table, items, cats = _setup(spark, tmp_dir)
    out = os.path.join(tmp_dir, "out")
    jobs.run_analysis(spark, table, items, cats, out)
    rows = spark.read.option("header", True).csv(os.path.join(out, "total_price_to_date")).collect()
    dates = [r.sale_date for r in sorted(rows, key=lambda r: int(r["index"]))]
    assert dates == sorted(dates) and len(dates) == len(rows) > 20
