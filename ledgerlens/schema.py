"""Fixed schemas of the sales data model.

``SALES_FILE_SCHEMA`` is the column order of a daily landing file;
``SALES_LOG_SCHEMA`` is the canonical in-memory log every operator expects.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Daily landing CSV, in file order (date text is dd.MM.yyyy). Price and
# count are parsed straight from text as double: a 32-bit float would turn
# 133.38 into 133.380005 before any arithmetic.
SALES_FILE_SCHEMA = T.StructType([
    T.StructField("sale_date", T.StringType()),
    T.StructField("month_num", T.ShortType()),
    T.StructField("shop_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_price", T.DoubleType()),
    T.StructField("item_cnt_day", T.DoubleType()),
])

# Canonical sales log: a real DATE and widened numeric types.
SALES_LOG_SCHEMA = T.StructType([
    T.StructField("sale_date", T.DateType()),
    T.StructField("month_num", T.IntegerType()),
    T.StructField("shop_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_price", T.DoubleType()),
    T.StructField("item_cnt_day", T.DoubleType()),
])

ITEMS_SCHEMA = T.StructType([
    T.StructField("item_name", T.StringType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_category_id", T.IntegerType()),
])

CATEGORIES_SCHEMA = T.StructType([
    T.StructField("item_category_name", T.StringType()),
    T.StructField("item_category_id", T.IntegerType()),
])

# Column order of the month-partitioned table: partition column last.
SALES_TABLE_COLUMNS = ["sale_date", "shop_id", "item_id", "item_price",
                       "item_cnt_day", "month_num"]

# Older exports use these names.
LEGACY_COLUMN_NAMES = {"date": "sale_date", "date_block_num": "month_num"}

SALE_DATE_FORMAT = "dd.MM.yyyy"
