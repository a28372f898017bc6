"""Incremental ingestion of daily sales files (S6) and the daily run.

A drop folder receives one CSV per day. Structured Streaming's file source
remembers which files it has processed (in the checkpoint), so a file is
loaded exactly once even if the job is restarted or run again; processed
files are moved to an archive folder. ``Trigger.AvailableNow`` processes
whatever has arrived and stops, which fits a scheduled daily job.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans import reports
from ledgerlens.schema import SALES_FILE_SCHEMA
from ledgerlens.sources.files import (CHECKED_OPTIONS, CHECKED_SCHEMA, CSV_OPTIONS, checked_sales,
                                      to_sales_log)
from ledgerlens.sources.ledger import read_latest_days
from ledgerlens.sources.publication import publish
from ledgerlens.sources.sinks import write_report, write_sales_log

REJECT_REASONS = ("fields", "value", "date")


def sales_stream(spark: SparkSession, drop_dir: str, archive_dir: str | None = None,
                 max_files_per_trigger: int | None = None, checked: bool = False) -> DataFrame:
    """Streaming view of the drop folder as the canonical sales log (with the
    columns of :func:`checked_sales` if ``checked``)."""
    schema, options = (CHECKED_SCHEMA, CHECKED_OPTIONS) if checked else (SALES_FILE_SCHEMA, CSV_OPTIONS)
    reader = spark.readStream.schema(schema).options(**options)
    if archive_dir:
        reader = (reader.option("cleanSource", "archive")
                  .option("sourceArchiveDir", archive_dir))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.csv(drop_dir)
    return checked_sales(rows) if checked else to_sales_log(rows)


def ingest_available(spark: SparkSession, drop_dir: str, table_dir: str, checkpoint: str,
                     archive_dir: str | None = None, rejects_dir: str | None = None) -> dict[str, int]:
    """Load every new file in ``drop_dir`` into the month-partitioned
    table at ``table_dir`` once, then stop. Returns how many rows this run took
    and, with ``rejects_dir``, rejected by reason.

    Rows go to the partition of their own ``month_num``, so a late file lands
    in its old month. Every micro-batch goes through the batch writer as a
    load of its own (named by the stream and the batch), so back-filled,
    appended and ingested rows share one table, and a batch that is run
    again after a failure replaces what its first attempt wrote.

    With ``rejects_dir`` rows that do not fit the landing schema or have no
    readable date go there (``reason, raw, file``, by load) and not into the
    table. Without it fields that cannot be read are null and their rows stay.
    """
    counts: Counter = Counter()

    def named(batch: DataFrame, batch_id: int) -> str:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        return f"{stream}-{batch_id}"

    def load(batch: DataFrame, batch_id: int) -> None:
        taken = Observation()
        write_sales_log(batch.observe(taken, F.count(F.lit(1)).alias("taken")), table_dir,
                        mode="load", load_id=named(batch, batch_id))
        counts.update(taken.get)

    def load_checked(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        bad = (batch.observe(seen, F.count_if(F.col("_reject").isNull()).alias("taken"), *[
            F.count_if(F.col("_reject") == r).alias(r) for r in REJECT_REASONS])
            .filter("_reject IS NOT NULL")
            .select(F.col("_reject").alias("reason"), F.col("_raw").alias("raw"),
                    F.col("_file").alias("file"), F.lit(named(batch, batch_id)).alias("load_id")))
        (bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("load_id").parquet(rejects_dir))
        write_sales_log(batch.filter("_reject IS NULL"), table_dir, mode="load",
                        load_id=named(batch, batch_id))
        counts.update(seen.get)

    rows = sales_stream(spark, drop_dir, archive_dir, checked=bool(rejects_dir))
    query = (rows.writeStream.foreachBatch(load_checked if rejects_dir else load)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
    return dict(counts)


def daily_pipeline(spark: SparkSession, drop_dir: str, table_dir: str, checkpoint: str,
                   items: DataFrame, categories: DataFrame, report_dir: str | None = None,
                   archive_dir: str | None = None,
                   publish_dir: str | None = None) -> dict[str, DataFrame]:
    """Ingest new files, then compute the four reports on the table.

    The reports read only the months whose dates can hold the last two days.
    With ``report_dir`` each report is also written as one CSV, with
    ``publish_dir`` all four are published there as one set.
    """
    ingest_available(spark, drop_dir, table_dir, checkpoint, archive_dir)
    log = read_latest_days(spark, table_dir)
    out = {
        "by_category": reports.report_by_category(log, items, categories),
        "top_goods": reports.report_top_goods(log, items),
        "top_goods_sale": reports.report_top_goods_sale(log, items),
        "top_difference": reports.report_top_difference(log, items),
    }
    if report_dir:
        for name, df in out.items():
            write_report(df, os.path.join(report_dir, name))
    if publish_dir:
        publish(spark, publish_dir, {name: partial(write_report, df) for name, df in out.items()})
    return out
