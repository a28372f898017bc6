"""Star-schema views over the driver's TPC-H-like tables.

The analyses are written against the canonical sales data model
(``sales_log``, ``items``, ``item_categories``). Two mappings turn the
driver tables into that model; each comes as DataFrames (for the Spark side)
and as SQL CTE text (for the second-engine oracle), kept side by side so the
two never drift apart.

* Mapping A ("bulk"): lineitem is the sales log, part the items, distinct
  brands the categories. Returns come from ``l_returnflag = 'R'``.
* Mapping B ("daily"): events is the sales log (one unit per event, an
  ``error`` event is a return), customers are items, nations categories.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import month_index

# The month counter starts in January of this year.
MONTH_BASE_YEAR = 1995


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --------------------------------------------------------------- mapping A
def bulk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity")
    return li.select(
        F.to_date("l_shipdate").alias("sale_date"),
        month_index("l_shipdate", MONTH_BASE_YEAR).alias("month_num"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").alias("item_price"),
        F.when(F.col("l_returnflag") == "R", -qty).otherwise(qty).alias("item_cnt_day"),
    )


def bulk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_name").alias("item_name"),
        F.col("p_partkey").alias("item_id"),
        F.expr("try_cast(substr(p_brand, 7) AS INT)").alias("item_category_id"),
    )


def bulk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("item_category_name"),
        F.expr("try_cast(substr(p_brand, 7) AS INT)").alias("item_category_id"),
    ).distinct()


def bulk_type_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping A keyed by part type instead of part (a coarser item grain)."""
    log = bulk_log(spark, sf_dir)
    part = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type"))
    return (log.join(part, "item_id")
            .select("sale_date", "month_num", "shop_id",
                    F.col("p_type").alias("item_key"), "item_price", "item_cnt_day"))


# --------------------------------------------------------------- mapping B
def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return ev.select(
        F.to_date("ts").alias("sale_date"),
        month_index("ts", MONTH_BASE_YEAR).alias("month_num"),
        F.lit(0).cast("bigint").alias("shop_id"),
        F.col("user_id").alias("item_id"),
        F.col("value").alias("item_price"),
        F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.lit(1.0))
        .alias("item_cnt_day"),
    )


def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("item_name"),
        F.col("c_custkey").alias("item_id"),
        F.col("c_nationkey").alias("item_category_id"),
    )


def daily_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("item_category_name"),
        F.col("n_nationkey").alias("item_category_id"),
    )


def bulk_model(spark: SparkSession, sf_dir: str):
    """(log, items, categories) of mapping A."""
    return (bulk_log(spark, sf_dir), bulk_items(spark, sf_dir),
            bulk_categories(spark, sf_dir))


def daily_model(spark: SparkSession, sf_dir: str):
    """(log, items, categories) of mapping B."""
    return (daily_log(spark, sf_dir), daily_items(spark, sf_dir),
            daily_categories(spark, sf_dir))


# ------------------------------------------------------- SQL form (oracle)
# The same two mappings as CTEs over the pre-registered driver views.
BULK_CTE = """
bulk_log AS (
  SELECT CAST(l_shipdate AS DATE) AS sale_date,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month_num,
         l_suppkey AS shop_id,
         l_partkey AS item_id,
         l_extendedprice AS item_price,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS item_cnt_day
  FROM lineitem),
bulk_sales AS (SELECT * FROM bulk_log WHERE item_cnt_day > 0),
bulk_items AS (
  SELECT p_name AS item_name, p_partkey AS item_id,
         TRY_CAST(substr(p_brand, 7) AS INTEGER) AS item_category_id
  FROM part),
bulk_categories AS (
  SELECT DISTINCT p_brand AS item_category_name,
         TRY_CAST(substr(p_brand, 7) AS INTEGER) AS item_category_id
  FROM part)
"""

DAILY_CTE = """
daily_log AS (
  SELECT CAST(ts AS DATE) AS sale_date,
         CAST((year(ts) - 1995) * 12 + month(ts) - 1 AS INTEGER) AS month_num,
         CAST(0 AS BIGINT) AS shop_id,
         user_id AS item_id,
         value AS item_price,
         CASE WHEN event_type = 'error' THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS item_cnt_day
  FROM events),
daily_items AS (
  SELECT c_name AS item_name, c_custkey AS item_id, c_nationkey AS item_category_id
  FROM customer),
daily_categories AS (
  SELECT n_name AS item_category_name, n_nationkey AS item_category_id FROM nation)
"""
