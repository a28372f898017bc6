"""Readers of the sales landing files and of stored tables.

Schemas are always explicit (no inference). Files are read in one
multi-file scan; per-file work uses the hidden ``_metadata`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dates import parse_date
from ledgerlens.schema import (CATEGORIES_SCHEMA, ITEMS_SCHEMA, LEGACY_COLUMN_NAMES,
                               SALE_DATE_FORMAT, SALES_FILE_SCHEMA, SALES_LOG_SCHEMA)
from ledgerlens.sources import ledger

CSV_OPTIONS = {"header": "true", "sep": ",", "mode": "PERMISSIVE"}
# Landing rows that do not fit the schema keep their text in one more column;
# without pruning every field of a row is checked, whatever is asked for.
CORRUPT = "_corrupt_record"
CHECKED_SCHEMA = T.StructType([*SALES_FILE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
CHECKED_OPTIONS = {**CSV_OPTIONS, "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
# Quoted dimension files: a doubled quote inside a quoted field is a quote.
QUOTED_CSV_OPTIONS = {**CSV_OPTIONS, "quote": '"', "escape": '"'}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename legacy columns (``date``, ``date_block_num``) when present."""
    for old, new in LEGACY_COLUMN_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def to_sales_log(raw: DataFrame, date_format: str = SALE_DATE_FORMAT,
                 drop_bad_dates: bool = False) -> DataFrame:
    """Canonical sales log from landing rows: a real DATE, widened types,
    columns selected by name (never by position). A date that cannot be read
    is null; its row stays, in the month the file names."""
    raw = normalise_columns(raw)
    d = raw["sale_date"]
    date = d if isinstance(raw.schema["sale_date"].dataType, T.DateType) \
        else parse_date(d, date_format)
    out = raw.select(
        date.alias("sale_date"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SALES_LOG_SCHEMA.fields[1:]])
    return out.filter(F.col("sale_date").isNotNull()) if drop_bad_dates else out


def read_sales_csv(spark: SparkSession, path, schema: T.StructType = SALES_FILE_SCHEMA,
                   raw: bool = False) -> DataFrame:
    """Daily sales CSV files (one header line each) as the sales log.

    ``path`` may be a folder, a glob or a list. ``raw=True`` keeps the file
    columns as they are (date as text).
    """
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return df if raw else to_sales_log(df)


def read_dim_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """A dimension CSV with quoted fields and doubled-quote escapes."""
    return spark.read.schema(schema).options(**QUOTED_CSV_OPTIONS).csv(path)


def read_items_csv(spark: SparkSession, path) -> DataFrame:
    return read_dim_csv(spark, path, ITEMS_SCHEMA)


def read_categories_csv(spark: SparkSession, path) -> DataFrame:
    return read_dim_csv(spark, path, CATEGORIES_SCHEMA)


def read_first_n_files(spark: SparkSession, path, n: int, skip: int = 0,
                       schema: T.StructType = SALES_FILE_SCHEMA) -> DataFrame:
    """Rows of the first ``n`` files in modification-time order (ties by
    name), after skipping the first ``skip`` files.

    The order comes from a file listing that reads no content; the at most
    ``n`` paths chosen are all that the reader then opens.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    chosen = [r["path"] for r in listing.orderBy("modificationTime", "path").offset(skip).limit(n).collect()]
    if not chosen:
        return to_sales_log(spark.createDataFrame([], schema))
    return read_sales_csv(spark, chosen, schema)


def checked_sales(raw: DataFrame) -> DataFrame:
    """The sales log of landing rows read with ``CHECKED_SCHEMA``, and ``_reject``:
    why a row cannot be taken (``fields``: too few or too many, ``value``: not a
    number, ``date``: no such date), null for good rows; ``_raw`` and ``_file``
    say what and where it was."""
    line = F.col(CORRUPT)
    whole = F.concat_ws(CSV_OPTIONS["sep"], *[F.col(c).cast("string") for c in SALES_FILE_SCHEMA.fieldNames()])
    log = to_sales_log(raw).columns
    reject = (F.when(F.size(F.split(line, CSV_OPTIONS["sep"])) != len(SALES_FILE_SCHEMA), "fields")
              .when(line.isNotNull(), "value").when(parse_date("sale_date").isNull(), "date"))
    kept = raw.select("*", reject.alias("_reject"), F.coalesce(line, whole).alias("_raw"),
                      F.col("_metadata.file_path").alias("_file"))
    return kept.withColumn("sale_date", parse_date("sale_date")).select(
        *[F.col(c).cast(SALES_LOG_SCHEMA[c].dataType).alias(c) for c in log], "_reject", "_raw", "_file")


def count_files(spark: SparkSession, path) -> int:
    """Number of data files under ``path`` (a listing, no content is read)."""
    return spark.read.format("binaryFile").load(path).select("path").count()


def load(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A stored table by catalog name, or a Parquet folder by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_sales_table(spark: SparkSession, path: str) -> DataFrame:
    """The month-partitioned sales table written by the sinks / ingestion,
    without loads that a compaction replaced."""
    return ledger.read_table(spark, path).select(*SALES_LOG_SCHEMA.fieldNames())
