"""Hand-made tables and reference forms that the tests share."""

SMOKE_DIR = "/root/testdata/sf0.001"


def make_log(spark, rows):
    """rows: (date 'YYYY-MM-DD', item_id, price, count[, month_num])."""
    import datetime as dt
    from ledgerlens.schema import SALES_LOG_SCHEMA
    out = []
    for r in rows:
        d = dt.date.fromisoformat(r[0])
        month = r[4] if len(r) > 4 else (d.year - 2013) * 12 + d.month - 1
        out.append((d, month, 0, r[1], float(r[2]), float(r[3])))
    return spark.createDataFrame(out, SALES_LOG_SCHEMA)


def make_items(spark, rows):
    """rows: (item_id, item_name, item_category_id)."""
    from ledgerlens.schema import ITEMS_SCHEMA
    return spark.createDataFrame([(n, i, c) for i, n, c in rows], ITEMS_SCHEMA)


def make_categories(spark, rows):
    from ledgerlens.schema import CATEGORIES_SCHEMA
    return spark.createDataFrame([(n, i) for i, n in rows], CATEGORIES_SCHEMA)


def plain_running_total(df, value, key, frame):
    """The single-partition windows the distributed running sums must equal."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    w = Window.orderBy(F.desc(value))
    if frame == "rows":
        w = (Window.orderBy(F.desc(value), F.asc(key))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("cumsum", F.sum(value).over(w))
