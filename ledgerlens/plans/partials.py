"""Totals kept per load, so that a new day is the only thing read anew.

For every partition (month, load) of the sales table :func:`update` keeps one
small table of sums per (month, day, item): units, exact amount, exact price
sum and number of priced rows of positive sales. Sums of these sums equal
sums over the rows, so all analyses (R5-R14) derive from them. A compacted
load takes over the sums of the loads it replaced.

Sums are stored by partition folder, so a load that runs again replaces its
own. Where the rows of a load are changed by hand, delete its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import AMOUNT, amount_to_double, sum_amount, sum_price
from ledgerlens.operators.filters import positive_sales
from ledgerlens.plans import calendar as K
from ledgerlens.session import materialize
from ledgerlens.sources import ledger

_KEYS = ("month_num", "sale_date", "item_id")
_SCHEMA = (f"sale_date date, item_id long, units double, amount {AMOUNT}, price_sum decimal(38,0), "
           "n_prices long, month_num int, load_id string")


def load_totals(sales: DataFrame) -> DataFrame:
    """Mergeable sums per (load, month, day, item)."""
    return sales.groupBy("load_id", *_KEYS).agg(
        F.sum("item_cnt_day").alias("units"),
        sum_amount("item_price", "item_cnt_day").alias("amount"),
        sum_price("item_price").alias("price_sum"), F.count("item_price").alias("n_prices"))


def _known(spark: SparkSession, store: str) -> set[tuple[str, str]]:
    """Partitions whose sums are there: written, and noted as finished (a load
    without a positive sale leaves no folder)."""
    return {tuple(name[:-5].split("+", 1)) for name in ledger._names(spark, f"{store}/_done")
            if name.endswith(".done")}


def _wanted(spark: SparkSession, table: str, known: set) -> tuple[set, set]:
    """(partitions whose sums make up the table, those of them to compute)."""
    commits = ledger._commits(spark, table)
    live, _ = ledger._live(spark, table, commits)
    parts, missing = set(), set()

    def origins(pair: tuple[str, str]) -> set | None:
        if pair in known:
            return {pair}
        replaced = [tuple(p) for p in commits.get(pair[1], []) if p[0] == pair[0]]
        found = [origins(p) for p in replaced]
        return set().union(*found) if replaced and None not in found else None

    for pair in live:
        found = origins(pair)
        parts |= found or {pair}
        missing |= set() if found else {pair}
    return parts, missing


def update(spark: SparkSession, table: str, store: str) -> int:
    """Compute the sums of loads that have none; returns how many partitions
    were read."""
    _, missing = _wanted(spark, table, _known(spark, store))
    if missing:
        rows = ledger.read_partitions(spark, table, missing)
        (load_totals(positive_sales(rows)).repartition("month_num", "load_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month_num", "load_id").parquet(store))
        for month, load in sorted(missing):
            ledger._write_whole(spark, f"{store}/_done/{month}+{load}.done", "")
    return len(missing)


def read(spark: SparkSession, table: str, store: str) -> DataFrame:
    """Sums per (month, day, item) and load over all loads of the table that
    count; call :func:`update` before."""
    parts, missing = _wanted(spark, table, _known(spark, store))
    if missing:
        raise ValueError(f"{len(missing)} partitions have no sums yet")
    rows = spark.read.schema(_SCHEMA).parquet(store)
    return rows.filter(ledger.folder().isin(["/".join(p) for p in sorted(parts)]))


# ------------------------------------------------- what the analyses start from
def period_totals(totals: DataFrame) -> DataFrame:
    """As ``classification.period_totals`` with revenue."""
    return materialize(totals.groupBy("month_num", "item_id").agg(
        F.sum("units").alias("item_cnt_month"), F.sum("amount").cast(AMOUNT).alias("_amount")))


def item_summary(totals: DataFrame) -> DataFrame:
    """As ``prices.item_summary``."""
    return materialize(totals.groupBy("item_id").agg(
        F.sum("units").alias("item_cnt_day"),
        F.sum("price_sum").cast("decimal(38,0)").alias("_p_sum"), F.sum("n_prices").alias("_p_n")))


def daily_table(totals: DataFrame) -> DataFrame:
    """As ``calendar.daily_table``."""
    daily = totals.groupBy("sale_date", "month_num").agg(F.sum("amount").cast(AMOUNT).alias(K._AMT))
    return materialize(daily.withColumn(K.DAY, amount_to_double(K._AMT)))


def category_daily(totals: DataFrame, items: DataFrame, categories: DataFrame, n: int = 5) -> DataFrame:
    """As ``calendar.category_daily``."""
    per_item = totals.groupBy("sale_date", "month_num", "item_id").agg(
        F.sum("units").alias("_units"), F.sum("amount").cast(AMOUNT).alias(K._AMT))
    return K.category_daily(None, items, categories, n, per_item=per_item)
