import os
import time

from builders import make_log
from pyspark.sql import functions as F

from ledgerlens.schema import ITEMS_SCHEMA
from ledgerlens.sources import files, sinks
from ledgerlens.streaming.ingest import ingest_available


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


HEADER = "sale_date,month_num,shop_id,item_id,item_price,item_cnt_day\n"


def test_quoted_names_with_doubled_quotes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "items.csv")
    _write(p, 'item_name,item_id,item_category_id\n"Set ""A"" + ""B"", x",1,5\nplain,2,6\n')
    rows = files.read_items_csv(spark, p).orderBy("item_id").collect()
    assert rows[0].item_name == 'Set "A" + "B", x' and rows[0].item_category_id == 5
    assert rows[1].item_name == "plain"


def test_sales_csv_parses_dates(spark, tmp_dir):
    p = os.path.join(tmp_dir, "day1.csv")
    _write(p, HEADER + "01.02.2013,1,0,5,2499.5,1.0\n13.01.2013,0,0,6,10,2\n"
               "31.02.2013,1,0,7,1,1\n,1,0,8,1,1\nnot a date,1,0,9,1,1\n")
    rows = files.read_sales_csv(spark, p).orderBy("item_id").collect()
    assert [(r.sale_date and str(r.sale_date), r.item_id) for r in rows] == [
        ("2013-02-01", 5), ("2013-01-13", 6), (None, 7), (None, 8), (None, 9)]
    assert rows[0].item_price == 2499.5


def test_legacy_column_names(spark):
    df = spark.createDataFrame([("01.01.2013", 0)], "date string, date_block_num int")
    assert files.normalise_columns(df).columns == ["sale_date", "month_num"]


def test_first_n_files_by_modification_time(spark, tmp_dir):
    for i, day in enumerate(["03", "01", "02"]):
        p = os.path.join(tmp_dir, f"f{day}.csv")
        _write(p, HEADER + f"{day}.01.2013,0,0,{i},1,1\n")
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    got = files.read_first_n_files(spark, tmp_dir, n=2)
    assert sorted(r.item_id for r in got.collect()) == [0, 1]
    skipped = files.read_first_n_files(spark, tmp_dir, n=5, skip=1)
    assert sorted(r.item_id for r in skipped.collect()) == [1, 2]


def test_partitioned_write_and_append(spark, tmp_dir):
    log = make_log(spark, [("2013-01-05", 1, 1, 1), ("2013-02-05", 2, 1, 1)])
    path = os.path.join(tmp_dir, "sales")
    sinks.write_sales_log(log, path)
    sinks.append_sales(make_log(spark, [("2013-01-06", 3, 1, 1)]), path)
    assert sorted(os.listdir(path))[:2] == ["_SUCCESS", "month_num=0"] or \
        "month_num=0" in os.listdir(path)
    back = files.read_sales_table(spark, path)
    assert back.count() == 3
    assert back.filter("month_num = 0").count() == 2


def test_reports_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'Set "A", x', 2.5), (2, "b", 1.0)],
                               "item_id long, item_name string, sale double")
    p = os.path.join(tmp_dir, "r")
    sinks.write_report(df, p)
    back = files.read_dim_csv(spark, p, "item_id long, item_name string, sale double")
    assert sorted(back.collect()) == sorted(df.collect())
    ip = os.path.join(tmp_dir, "ix")
    sinks.write_indexed_report(df, ip, "sale", "item_id")
    idx = sorted(spark.read.option("header", True).csv(ip).collect())
    assert [(r["index"], r.item_id) for r in idx] == [("0", "1"), ("1", "2")]
    tsv = os.path.join(tmp_dir, "t.tsv")
    _write(tsv, "a\tb\nx\t\"y\"\n")
    sinks.tsv_to_csv(spark, tsv, os.path.join(tmp_dir, "t.csv"))
    got = spark.read.options(**files.QUOTED_CSV_OPTIONS).csv(os.path.join(tmp_dir, "t.csv")).collect()
    assert got[0].a == "x"


def test_ingest_is_incremental_and_idempotent(spark, tmp_dir):
    drop, table, ckpt, archive = (os.path.join(tmp_dir, n) for n in ("drop", "t", "c", "a"))
    os.makedirs(drop)
    _write(os.path.join(drop, "day1.csv"), HEADER + "30.12.2014,23,0,1,10,1\n")
    ingest_available(spark, drop, table, ckpt, archive)
    assert files.read_sales_table(spark, table).count() == 1
    time.sleep(1.1)
    _write(os.path.join(drop, "day2.csv"), HEADER + "31.12.2014,23,0,2,10,2\n01.12.2014,23,0,3,5,1\n")
    ingest_available(spark, drop, table, ckpt, archive)
    ingest_available(spark, drop, table, ckpt, archive)  # a repeated run adds nothing
    back = files.read_sales_table(spark, table)
    assert back.count() == 3
    assert back.groupBy("item_id").count().filter("count > 1").count() == 0


def test_backfill_ingestion_and_append_share_one_table(spark, tmp_dir):
    import os

    from ledgerlens.sources.files import read_sales_table
    from ledgerlens.sources.sinks import append_sales, sales_log_to_csv, write_sales_log
    from builders import make_log

    table, drop, ckpt = (os.path.join(tmp_dir, n) for n in ("t", "d", "c"))
    write_sales_log(make_log(spark, [("2013-01-02", k, 1.5, 1) for k in range(3)]), table)
    sales_log_to_csv(make_log(spark, [("2013-02-01", 7, 2.0, 1)]), drop + "/a")
    ingest_available(spark, drop + "/*", table, ckpt)
    assert read_sales_table(spark, table).count() == 4
    append_sales(make_log(spark, [("2013-02-02", 8, 2.0, 1)]), table)
    ingest_available(spark, drop + "/*", table, ckpt)
    assert read_sales_table(spark, table).count() == 5
    # A load that is run again replaces its own rows only.
    for _ in range(2):
        write_sales_log(make_log(spark, [("2013-02-03", 9, 2.0, 1)]), table, mode="load", load_id="x")
    assert read_sales_table(spark, table).count() == 6


def test_rows_with_unreadable_dates_are_kept(spark, tmp_dir):
    import os

    from ledgerlens.sources.files import read_sales_csv
    path = os.path.join(tmp_dir, "bad.csv")
    with open(path, "w") as f:
        f.write("date,date_block_num,shop_id,item_id,item_price,item_cnt_day\n"
                "02.01.2013,0,1,2,3.0,1\nnot a date,0,1,3,3.0,1\n")
    rows = read_sales_csv(spark, path).orderBy("item_id").collect()
    assert [r.sale_date is None for r in rows] == [False, True]
