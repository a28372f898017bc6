import random

from builders import plain_running_total
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.running import position_within, prefix_sum, running_total


def _totals(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a hot value held by a third of the keys, plus a spread of others
        v = 7.0 if i % 3 == 0 else float(rnd.randint(1, 60))
        rows.append((i, v))
    return spark.createDataFrame(rows, "item_id long, units double")


def _by_key(df, col):
    return {r.item_id: r[col] for r in df.collect()}


def test_range_frame_equals_plain_window(spark):
    t = _totals(spark)
    got = _by_key(running_total(t, "units", "item_id", frame="range", buckets=8), "cumsum")
    want = _by_key(plain_running_total(t, "units", "item_id", "range"), "cumsum")
    assert got == want


def test_rows_frame_equals_plain_window(spark):
    t = _totals(spark, seed=2)
    got = _by_key(running_total(t, "units", "item_id", frame="rows", buckets=8), "cumsum")
    want = _by_key(plain_running_total(t, "units", "item_id", "rows"), "cumsum")
    assert got == want


def test_running_sum_ends_at_total(spark):
    t = _totals(spark, seed=3)
    r = running_total(t, "units", "item_id", buckets=5)
    total = t.agg(F.sum("units")).first()[0]
    assert r.agg(F.max("cumsum")).first()[0] == total


def test_partitioned_prefix_sum(spark):
    rows = [(g, i, float(i % 5 + 1)) for g in range(3) for i in range(50 * (g + 1))]
    df = spark.createDataFrame(rows, "g int, k long, v double")
    got = {(r.g, r.k): r.cs for r in
           prefix_sum(df, "k", "v", "cs", partition_cols=["g"], descending=False, buckets=6).collect()}
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.k): r.cs for r in df.withColumn("cs", F.sum("v").over(w)).collect()}
    assert got == want


def test_position_within_equals_row_number(spark):
    rows = [(i % 2 if i % 7 else 2, i) for i in range(300)]  # one hot group
    df = spark.createDataFrame(rows, "g int, k long")
    got = {r.k: r.pos for r in position_within(df, ["g"], "k", "pos", buckets=10).collect()}
    w = Window.partitionBy("g").orderBy("k")
    want = {r.k: r.pos for r in df.withColumn("pos", F.row_number().over(w)).collect()}
    assert got == want


def test_ordered_index_equals_row_number(spark):
    from ledgerlens.operators.running import ordered_index
    rows = [(i, None if i % 11 == 0 else float(i % 4 if i % 3 else 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, v double")
    got = {r.item_id: r["index"] for r in ordered_index(df, "v", "item_id", buckets=4).collect()}
    w = Window.orderBy(F.desc_nulls_last("v"), F.asc("item_id"))
    want = {r.item_id: r.ix for r in df.withColumn("ix", F.row_number().over(w) - 1).collect()}
    assert got == want


def test_positions_by_a_text_key(spark):
    from ledgerlens.operators.running import position_within
    rows = [(k % 2, f"item {'é' if k % 3 else 'z'}{k:03d}") for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k string")
    got = {(r.g, r.k): r.position for r in position_within(df, ["g"], "k", buckets=8).collect()}
    for g in (0, 1):
        mine = sorted((k for h, k in rows if h == g), key=lambda s: s.encode())
        assert [got[g, k] for k in mine] == list(range(1, len(mine) + 1))


def _index(df, order, key, **kw):
    from ledgerlens.operators.running import ordered_index
    return {r[key]: r["index"] for r in ordered_index(df, order, key, **kw).collect()}


def _plain_index(df, order, key, descending):
    order = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
    ranked = df.withColumn("ix", F.row_number().over(Window.orderBy(order, F.asc(key))) - 1)
    return {r[key]: r.ix for r in ranked.collect()}


def test_ordered_index_of_any_type_equals_row_number(spark):
    base = spark.range(400).withColumnRenamed("id", "k")
    kinds = {
        "bigint": "9007199254740992 + k % 7",
        "decimal": "CAST(1e20 AS DECIMAL(38,6)) + CAST(k % 13 AS DECIMAL(38,6)) / 1000000",
        "text": "concat('item-000000', CASE WHEN k % 3 = 0 THEN 'é' ELSE 'z' END, k % 11)",
        "date": "date_add(DATE'2014-01-01', CAST(k % 17 AS INT))",
        "boolean": "k % 2 = 0",
        "binary": "CAST(concat('b', k % 5) AS BINARY)",
    }
    for kind, value in kinds.items():
        df = base.selectExpr("k", f"CASE WHEN k % 19 = 0 THEN NULL ELSE {value} END AS v")
        for descending in (True, False):
            got = _index(df, "v", "k", descending=descending, buckets=6)
            assert got == _plain_index(df, "v", "k", descending), kind


def test_long_common_prefixes_are_split(spark):
    from ledgerlens.operators.running import BUCKET, split_ranges
    from ledgerlens.session import materialize
    df = materialize(spark.range(4000).selectExpr("concat('item-', lpad(id, 9, '0')) AS k"))
    sizes = [r["count"] for r in split_ranges(df, [F.asc("k")], 8).groupBy(BUCKET).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_rows_equal_in_every_order_column_are_split(spark):
    from ledgerlens.operators.running import BUCKET, ordered_index, split_ranges
    from ledgerlens.session import materialize
    df = materialize(spark.range(4000).selectExpr("1 AS v", "2 AS k", "id"))
    staged = split_ranges(df, [F.asc("v"), F.asc("k")], 8)
    assert staged.groupBy(BUCKET).count().agg(F.max("count")).first()[0] < 1500
    index = sorted(r["index"] for r in ordered_index(df, "v", "k", buckets=8).collect())
    assert index == list(range(4000))


def test_null_values_keep_their_keys_in_both_frames(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, units double")
    for frame in ("range", "rows"):
        got = _by_key(running_total(df, "units", "item_id", frame=frame, buckets=4), "cumsum")
        assert len(got) == 60
        w = Window.orderBy(F.desc_nulls_last("units"), *([F.asc("item_id")] if frame == "rows" else []))
        if frame == "rows":
            w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = _by_key(df.withColumn("cumsum", F.sum("units").over(w)), "cumsum")
        assert got == want
    small = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, None)], "item_id long, units double")
    assert _by_key(running_total(small, "units", "item_id"), "cumsum") == {1: 5.0, 2: 8.0, 3: 8.0}


def test_only_nulls_and_no_rows(spark):
    nulls = spark.createDataFrame([(1, None), (2, None)], "item_id long, units double")
    none = nulls.filter("false")
    for frame in ("range", "rows"):
        assert _by_key(running_total(nulls, "units", "item_id", frame=frame), "cumsum") == {1: None, 2: None}
        assert running_total(none, "units", "item_id", frame=frame).count() == 0
    assert _index(none, "units", "item_id") == {}
    assert _index(nulls, "units", "item_id") == {1: 0, 2: 1}


def test_null_groups_and_null_orders_have_positions(spark):
    rows = [(None if i % 4 == 0 else i % 2, None if i % 9 == 0 else i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, o long, k long")
    got = {r.k: r.position for r in position_within(df, ["g"], "o", buckets=5).collect()}
    assert len(got) == 100
    w = Window.partitionBy("g").orderBy(F.asc_nulls_last("o"))
    want = df.withColumn("p", F.row_number().over(w)).collect()
    assert all(got[r.k] == r.p for r in want if r.o is not None)
    for g in (None, 0, 1):
        mine = [got[r.k] for r in want if r.g == g]
        assert sorted(mine) == list(range(1, len(mine) + 1))
