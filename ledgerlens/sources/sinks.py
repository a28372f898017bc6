"""Writers: Parquet tables (S3-S5) and report files (K1-K4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import format_date
from ledgerlens.operators.running import ordered_index
from ledgerlens.schema import SALES_TABLE_COLUMNS
from ledgerlens.sources.ledger import note_bounds

PARQUET_COMPRESSION = "snappy"


def load_dimension(df: DataFrame, path: str) -> None:
    """S3: full refresh of a dimension table."""
    df.write.mode("overwrite").option("compression", PARQUET_COMPRESSION).parquet(path)


def write_sales_log(log: DataFrame, path: str, mode: str = "overwrite",
                    load_id: str = "bulk") -> None:
    """The fact table, partitioned by month and load.

    Rows are range-partitioned by (month, date, item, shop, price) before
    writing: each task then covers a contiguous slice and writes into one or
    two month folders, while a large month, a hot day or a hot item of one
    day is still spread over many tasks. Sorting inside each task keeps the
    Parquet min/max statistics of ``sale_date`` tight, so a filter on a day
    skips most row groups.

    ``load_id`` names the load. ``mode="load"`` replaces what an earlier
    attempt of the same load wrote and nothing else, so a retried load adds
    its rows once. The date bounds of the months written are recorded beside
    the table (:mod:`ledgerlens.sources.ledger`).
    """
    keys = ["month_num", "sale_date", "item_id"]
    rows = (log.select(*SALES_TABLE_COLUMNS).withColumn("load_id", F.lit(load_id))
            .repartitionByRange(*keys, "shop_id", "item_price")
            .sortWithinPartitions(*keys))
    writer = rows.write.mode("append" if mode == "append" else "overwrite")
    if mode == "load":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.option("compression", PARQUET_COMPRESSION)
     .partitionBy("month_num", "load_id").parquet(path))
    note_bounds(log.sparkSession, path, load_id)


def append_sales(log: DataFrame, path: str, load_id: str | None = None) -> None:
    """Append new rows; the partitions come from the rows' own month."""
    write_sales_log(log, path, mode="append", load_id=load_id or f"append-{uuid.uuid4().hex}")


def write_report(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """K1/K3: one CSV file with a header, for small final results only.

    Fields are quoted when needed (always with ``quote_all``); a quote inside
    a field is doubled, so the file reads back with the quoted-CSV reader.
    """
    (df.coalesce(1).write.mode("overwrite")
     .option("header", "true").option("quote", '"').option("escape", '"')
     .option("quoteAll", "true" if quote_all else "false")
     .csv(path))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """A table of any size as CSV part files written in parallel (header in
    each part, quotes doubled inside quoted fields)."""
    (df.write.mode("overwrite")
     .option("header", "true").option("quote", '"').option("escape", '"')
     .option("quoteAll", "true" if quote_all else "false")
     .csv(path))


def write_indexed_report(df: DataFrame, path: str, order_col: str, key_col: str,
                         descending: bool = True) -> None:
    """K2: a table of any size as CSV with a leading 0-based row index, in the
    order of ``order_col`` (ties by ``key_col``). The part files follow each
    other in that order."""
    indexed = ordered_index(df, order_col, key_col, descending=descending)
    write_csv(indexed.select("index", *df.columns).orderBy("index"), path)


def sales_log_to_csv(log: DataFrame, path: str) -> None:
    """Landing-file form of a log (date as dd.MM.yyyy text), one folder."""
    (log.select(format_date("sale_date").alias("sale_date"), "month_num", "shop_id",
                "item_id", "item_price", "item_cnt_day")
     .write.mode("overwrite").option("header", "true").csv(path))


def tsv_to_csv(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """K4: re-encode a tab-separated report (with header) as quoted CSV,
    a part file for each part read."""
    df = spark.read.option("sep", "\t").option("header", "true").csv(src)
    write_csv(df, dst)
    return df
