"""Rejects, month bounds and compaction of the sales table."""

import os

from builders import make_log
from pyspark.sql import functions as F

from ledgerlens.operators.filters import latest_day
from ledgerlens.sources import files, ledger, sinks
from ledgerlens.streaming.ingest import ingest_available

HEADER = "sale_date,month_num,shop_id,item_id,item_price,item_cnt_day\n"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def _items(df):
    return sorted(r.item_id for r in df.select("item_id").collect())


def _folders(path):
    return sum(len(dirs) for _, dirs, _ in os.walk(path))


def test_rejects_by_reason_are_counted_and_loaded_once(spark, tmp_dir):
    drop, table, bad, ckpt = (os.path.join(tmp_dir, n) for n in ("drop", "table", "bad", "ckpt"))
    _write(f"{drop}/a.csv", HEADER + "01.02.2013,1,0,5,2499.5,1.0\n02.02.2013,1,0,6,abc,1\n"
           "31.02.2013,1,0,7,1,1\n03.02.2013,1,0\n04.02.2013,1,0,8,1,1,9\n,1,0,9,1,1\n")
    counts = ingest_available(spark, drop, table, ckpt, rejects_dir=bad)
    assert counts == {"taken": 1, "value": 1, "date": 2, "fields": 2}
    rejected = spark.read.parquet(bad)
    assert sorted((r.reason, r.raw) for r in rejected.collect()) == [
        ("date", "1,0,9,1.0,1.0"), ("date", "31.02.2013,1,0,7,1.0,1.0"), ("fields", "03.02.2013,1,0"),
        ("fields", "04.02.2013,1,0,8,1,1,9"), ("value", "02.02.2013,1,0,6,abc,1")]
    assert all(r.file.endswith("a.csv") for r in rejected.collect())
    assert _items(files.read_sales_table(spark, table)) == [5]
    assert ingest_available(spark, drop, table, ckpt, rejects_dir=bad) == {}
    assert spark.read.parquet(bad).count() == 5


def test_a_load_of_rejects_only(spark, tmp_dir):
    drop, table, bad = (os.path.join(tmp_dir, n) for n in ("drop", "table", "bad"))
    _write(f"{drop}/a.csv", HEADER + "no,row,at,all\n")
    assert ingest_available(spark, drop, table, f"{tmp_dir}/ckpt", rejects_dir=bad)["fields"] == 1
    assert files.read_sales_table(spark, table).count() == 0


def test_latest_days_do_not_trust_the_month(spark, tmp_dir):
    table = os.path.join(tmp_dir, "sales")
    sinks.write_sales_log(make_log(spark, [
        ("2013-01-05", 1, 1, 1), ("2013-03-30", 2, 1, 1), ("2013-03-31", 3, 1, 1),
        ("2013-03-31", 4, 1, 1, 0), ("2013-03-30", 5, 1, 1, 99), ("2013-02-01", 6, 1, 1)]), table)
    log = ledger.read_latest_days(spark, table)
    assert _items(latest_day(log)) == [3, 4]
    assert 6 not in _items(log) and {2, 5} <= set(_items(log))
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws" in plan


def test_partitions_without_bounds_are_read(spark, tmp_dir):
    table = os.path.join(tmp_dir, "sales")
    sinks.write_sales_log(make_log(spark, [("2013-01-05", 1, 1, 1)]), table)
    late = make_log(spark, [("2013-04-01", 2, 1, 1, 0)]).withColumn("load_id", F.lit("foreign"))
    late.write.mode("append").partitionBy("month_num", "load_id").parquet(table)
    assert ledger.month_bounds(spark, table) is None
    assert _items(latest_day(ledger.read_latest_days(spark, table))) == [2]


def test_rows_without_a_month_or_date(spark, tmp_dir):
    table = os.path.join(tmp_dir, "sales")
    log = make_log(spark, [("2013-01-05", 1, 1, 1), ("2013-01-06", 2, 1, 1)])
    odd = log.filter("item_id = 2").withColumn("month_num", F.lit(None).cast("int"))
    undated = log.filter("item_id = 1").withColumns({"sale_date": F.lit(None).cast("date"),
                                                     "item_id": F.lit(3).cast("long")})
    sinks.write_sales_log(log.filter("item_id = 1").unionByName(odd).unionByName(undated), table)
    assert _items(files.read_sales_table(spark, table)) == [1, 2, 3]
    assert _items(latest_day(ledger.read_latest_days(spark, table))) == [2]


def _daily_loads(spark, table, first, last):
    for d in range(first, last):
        month, day = 1 + d // 4, 1 + d % 4
        sinks.write_sales_log(make_log(spark, [(f"2013-{month:02d}-{day:02d}", d, 1, 1)]), table,
                              mode="load", load_id=f"day-{d}")


def test_compaction_bounds_folders_and_keeps_every_row(spark, tmp_dir):
    table = os.path.join(tmp_dir, "sales")
    sizes = []
    for upto in (8, 16):
        _daily_loads(spark, table, upto - 8, upto)
        assert ledger.compact(spark, table)
        assert _items(files.read_sales_table(spark, table)) == list(range(upto))
        ledger.vacuum(spark, table)
        assert _items(files.read_sales_table(spark, table)) == list(range(upto))
        live = ledger.partitions(spark, table)
        months = {m for m, _ in live}
        newest = max(months, key=int)
        assert all(sum(x == m for x, _ in live) == 1 for m in months - {newest})
        sizes.append(_folders(table))
    # Two more months: a folder each for the month, its load, not one a day.
    assert sizes[1] - sizes[0] <= 6
    assert ledger.compact(spark, table) is None  # nothing left to merge
    assert _items(latest_day(ledger.read_latest_days(spark, table))) == [15]


def test_a_batch_that_runs_again_after_compaction_adds_nothing(spark, tmp_dir):
    table = os.path.join(tmp_dir, "sales")
    _daily_loads(spark, table, 0, 6)
    ledger.compact(spark, table)
    _daily_loads(spark, table, 1, 2)  # replaced, not yet deleted
    assert _items(files.read_sales_table(spark, table)) == list(range(6))
    ledger.vacuum(spark, table)
    _daily_loads(spark, table, 1, 2)  # its folder is gone and comes back
    assert _items(files.read_sales_table(spark, table)) == list(range(6))


def test_a_compaction_that_dies_before_its_commit_changes_nothing(spark, tmp_dir, monkeypatch):
    table = os.path.join(tmp_dir, "sales")
    _daily_loads(spark, table, 0, 6)
    before = files.read_sales_table(spark, table)

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(ledger, "_write_whole", dies)
    try:
        ledger.compact(spark, table)
    except OSError:
        pass
    assert _items(files.read_sales_table(spark, table)) == list(range(6))
    monkeypatch.undo()
    assert ledger.vacuum(spark, table) == 1  # the half-done load of the closed month
    ledger.compact(spark, table)
    assert _items(files.read_sales_table(spark, table)) == list(range(6))
    assert _items(before) == list(range(6))  # a reader from before still has its files


def test_only_the_chosen_files_are_opened(spark, tmp_dir):
    for i in range(4):
        p = os.path.join(tmp_dir, f"f{i}.csv")
        _write(p, HEADER + f"0{i + 1}.01.2013,0,0,{i},1,1\n")
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    two = files.read_first_n_files(spark, tmp_dir, n=2, skip=1)
    assert sorted(os.path.basename(f) for f in two.inputFiles()) == ["f1.csv", "f2.csv"]
    assert _items(two) == [1, 2]
    assert files.read_first_n_files(spark, tmp_dir, n=3, skip=9).count() == 0
