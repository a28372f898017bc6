"""Upkeep of the month-partitioned sales table: date bounds of its months, and
compaction.

*Bounds.* Every load leaves the least and greatest ``sale_date`` of each month
it wrote in ``_month_bounds`` below the table (a folder readers skip).
:func:`read_latest_days` reads only months whose dates can hold the newest
days. It relies on the dates written, not on ``month_num`` agreeing with them;
where a partition has no bounds (a load that died in between, a foreign
writer) the whole table is read.

*Compaction.* :func:`compact` rewrites the loads of closed months as one load,
``compact-<id>``, then commits it by one file in ``_compactions`` that names the
loads it replaces. The file appears by a rename, which is the switch: before
it readers skip the new load, after it the replaced ones, so no reader sees a
row twice or not at all. A replaced load stays replaced when its batch runs
again, as the file keeps its name. :func:`vacuum` deletes replaced loads and
those of compactions that died, once nothing reads them any more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import SALES_LOG_SCHEMA

BOUNDS, COMMITS, COMPACT = "_month_bounds", "_compactions", "compact-"
# Spark's folder name of a null partition value.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
_SCHEMA = T.StructType([*SALES_LOG_SCHEMA.fields, T.StructField("load_id", T.StringType())])


# ------------------------------------------------------------ file system
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there complete or not at all."""
    fs, where = _fs(spark, path)
    fs.mkdirs(where.getParent())
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, where):
        raise OSError(f"{path} could not be put in place")


def partitions(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(month, load) of every partition folder, as their names say."""
    return [(month.split("=", 1)[1], load.split("=", 1)[1])
            for month in _names(spark, path) if month.startswith("month_num=")
            for load in _names(spark, f"{path}/{month}") if load.startswith("load_id=")]


# ----------------------------------------------------------------- commits
def _commits(spark: SparkSession, path: str) -> dict[str, list]:
    """Replaced (month, load) pairs by committed compaction."""
    found = {}
    names = [n for n in _names(spark, f"{path}/{COMMITS}") if n.endswith(".json")]
    for row in (spark.read.text([f"{path}/{COMMITS}/{n}" for n in names], wholetext=True)
                .collect() if names else []):  # a few names each
        commit = json.loads(row["value"])
        found[commit["load"]] = [tuple(x) for x in commit["replaces"]]
    return found


def _live(spark: SparkSession, path: str, commits: dict[str, list]) -> tuple[list, list]:
    """Partitions that count, and those that do not."""
    gone = {x for replaced in commits.values() for x in replaced}
    every = partitions(spark, path)
    live = [p for p in every if p not in gone and (not p[1].startswith(COMPACT) or p[1] in commits)]
    return live, sorted(set(every) - set(live))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def folder() -> Column:
    """A row's partition folder as ``month/load``; a filter on it prunes."""
    return F.concat_ws("/", F.coalesce(F.col("month_num").cast("string"), F.lit(NO_MONTH)), "load_id")


def read_partitions(spark: SparkSession, path: str, wanted) -> DataFrame:
    """The rows of the named (month, load) partitions, with ``load_id``."""
    return _stored(spark, path).filter(folder().isin(["/".join(p) for p in sorted(wanted)]))


def read_table(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The rows that count (of the named months), with ``load_id``. Replaced
    and uncommitted loads are left out as partition folders."""
    # Commits first, then the files, then the folders: a compaction committed
    # in between is not seen at all.
    commits = _commits(spark, path)
    rows = _stored(spark, path)
    live, skipped = _live(spark, path, commits)
    if skipped:
        rows = rows.filter(~folder().isin(["/".join(p) for p in skipped]))
    if months is not None:
        rows = rows.filter(folder().isin(["/".join(p) for p in live if p[0] in months]))
    return rows


# ------------------------------------------------------------------ bounds
def note_bounds(spark: SparkSession, path: str, load_id: str) -> None:
    """Record the date bounds of the months a load wrote."""
    wrote = _stored(spark, path).filter(F.col("load_id") == load_id)
    bounds = wrote.groupBy(F.col("month_num").cast("string").alias("month"), "load_id").agg(
        F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"))
    (bounds.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load_id").parquet(f"{path}/{BOUNDS}"))


def month_bounds(spark: SparkSession, path: str) -> DataFrame | None:
    """``month, first_date, last_date, n_rows`` over the loads that count, or None
    where some of them have no bounds. (Rows are one a month and load.)"""
    live, _ = _live(spark, path, _commits(spark, path))
    if not live or not _names(spark, f"{path}/{BOUNDS}"):
        return None
    month = F.coalesce("month", F.lit(NO_MONTH))
    known = (spark.read.schema("month string, first_date date, last_date date, n_rows long, load_id string")
             .parquet(f"{path}/{BOUNDS}").withColumn("month", month))
    wanted = spark.createDataFrame(live, "month string, load_id string")
    found = wanted.join(known, ["month", "load_id"], "left").groupBy("month").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.sum("n_rows").alias("n_rows"), F.count_if(F.col("n_rows").isNull()).alias("_unknown"))
    return None if found.filter("_unknown > 0").limit(1).count() else found.drop("_unknown")


def read_latest_days(spark: SparkSession, path: str, days: int = 2) -> DataFrame:
    """The sales log restricted to the months that can hold its latest ``days``
    calendar days, whatever their ``month_num`` says; reports over it equal
    reports over the whole table."""
    bounds, months = month_bounds(spark, path), None
    if bounds is not None:
        newest = bounds.select(F.max("last_date")).scalar()
        months = [r["month"] for r in
                  bounds.filter(F.col("last_date") > F.date_sub(newest, days)).collect()]
    return read_table(spark, path, months or None).select(*SALES_LOG_SCHEMA.fieldNames())


# -------------------------------------------------------------- compaction
def compact(spark: SparkSession, path: str, keep_open: int = 1, least_loads: int = 2) -> str | None:
    """Rewrite every closed month (all but the ``keep_open`` newest) that has
    ``least_loads`` loads or more as one load; returns its name. File sizes
    follow the session's advisory partition size."""
    from ledgerlens.sources.sinks import write_sales_log

    live, _ = _live(spark, path, _commits(spark, path))
    order = sorted({m for m, _ in live if m.lstrip("-").isdigit()}, key=int)
    closed = set(order[:max(0, len(order) - keep_open)])
    counts = {m: sum(x == m for x, _ in live) for m in closed}
    replaced = [p for p in live if counts.get(p[0], 0) >= least_loads]
    if not replaced:
        return None
    load = f"{COMPACT}{uuid.uuid4().hex}"
    rows = read_table(spark, path, sorted({m for m, _ in replaced}))
    write_sales_log(rows, path, mode="load", load_id=load)
    _write_whole(spark, f"{path}/{COMMITS}/{load}.json",
                 json.dumps({"load": load, "replaces": replaced}))
    return load


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of replaced loads and of compactions that were not
    committed. Call it when no reader or compaction that began before is
    still running."""
    live, gone = _live(spark, path, _commits(spark, path))
    for month, load in gone:
        _delete(spark, f"{path}/month_num={month}/load_id={load}")
    for load in {load for _, load in gone} - {load for _, load in live}:
        _delete(spark, f"{path}/{BOUNDS}/load_id={load}")
    return len(gone)
