"""ABC / XYZ product classification.

* ABC ranks items by units sold: the running share of units, in descending
  order, rounded to 3 places, splits items into A (<= 0.6), B (<= 0.8), C.
* XYZ measures demand stability: the variation coefficient (population std
  / mean) of units per period, rounded to 3 places: X (<= 0.10), Y (<= 0.25), Z.

Both run on positive sales only. The running share never uses a
single-partition window (see :mod:`ledgerlens.operators.running`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.classes import ABC_CUTS, XYZ_CUTS, abc_class, xyz_class
from ledgerlens.functions.numeric import amount_to_double, sum_amount
from ledgerlens.operators.aggregates import class_share, demand_stats
from ledgerlens.operators.joins import join_items
from ledgerlens.operators.running import running_total, top_n_per_group
from ledgerlens.session import materialize

# The class labels, in report order.
ABC_LABELS = ("A", "B", "C")
XYZ_LABELS = ("X", "Y", "Z")


def period_totals(sales: DataFrame, key: str = "item_id", period: str = "month_num",
                  measure: str = "item_cnt_day", with_revenue: bool = False) -> DataFrame:
    """Units (and exact revenue) per (period, key), written once.

    This is the only aggregate over the fact table the classification needs:
    ABC totals, XYZ statistics and class revenue are all derived from it.
    """
    aggs = [F.sum(measure).alias("item_cnt_month")]
    if with_revenue:
        aggs.append(sum_amount("item_price", "item_cnt_day").alias("_amount"))
    return materialize(sales.groupBy(period, key).agg(*aggs))


def abc_from_totals(totals: DataFrame, key: str = "item_id", cuts=ABC_CUTS,
                    frame: str = "range", buckets: int | None = None) -> DataFrame:
    """R5 on per-key units (``key``, ``item_cnt_day``), already materialized."""
    ran = running_total(totals, "item_cnt_day", key, "cumsum", frame=frame, buckets=buckets,
                        prepared=True)
    total = totals.select(F.sum("item_cnt_day")).scalar()
    share = F.round(F.col("cumsum") / total, 3)
    return ran.select(key, "item_cnt_day", "cumsum", share.alias("percentage"),
                      abc_class(share, cuts).alias("abc"))


def xyz_from_periods(per: DataFrame, key: str = "item_id", period: str = "month_num",
                     cuts=XYZ_CUTS, zero_fill: bool = False, places: int = 6) -> DataFrame:
    """R6 on per-(period, key) units (``item_cnt_month``)."""
    periods = per.select(F.count_distinct(period)).scalar() if zero_fill else None
    stats = demand_stats(per, key, "item_cnt_month", periods)
    cv = F.round(F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)), 3)
    return stats.select(key, F.round("mean", places).alias("mean"),
                        F.round("std", places).alias("std"),
                        cv.alias("var_coeff"), xyz_class(cv, cuts).alias("xyz"))


def abc_analysis(sales: DataFrame, key: str = "item_id", measure: str = "item_cnt_day",
                 cuts=ABC_CUTS, frame: str = "range", buckets: int | None = None) -> DataFrame:
    """Per key its units, running units, running share and ABC class.

    ``frame="range"`` (default): keys with equal units share one running
    value. ``frame="rows"``: row by row with ``key`` ascending among ties.
    """
    totals = materialize(sales.groupBy(key).agg(F.sum(measure).alias("item_cnt_day")))
    return abc_from_totals(totals, key, cuts, frame, buckets)


def xyz_analysis(sales: DataFrame, key: str = "item_id", period: str = "month_num",
                 measure: str = "item_cnt_day", cuts=XYZ_CUTS,
                 zero_fill: bool = False, places: int = 6) -> DataFrame:
    """Per key mean / population std of units per period, variation, XYZ.

    Periods without a sale are absent by default (so a key sold in a single
    period has std 0 and is X). ``zero_fill=True`` counts every period of the
    data as a value, zero when nothing was sold.
    """
    per = sales.groupBy(period, key).agg(F.sum(measure).alias("item_cnt_month"))
    if zero_fill:
        # The period count and the statistics then read one written table
        # instead of scanning the sales twice.
        per = materialize(per)
    return xyz_from_periods(per, key, period, cuts, zero_fill, places)


def abc_xyz(sales: DataFrame | None, key: str = "item_id", period: str = "month_num",
            abc_kw: dict | None = None, xyz_kw: dict | None = None,
            per: DataFrame | None = None) -> DataFrame:
    """The (abc, xyz) class pair of each key (inner join of R5 and R6).

    Both classifications come from one (period, key) aggregate (``per``,
    built from ``sales`` when not given), so the fact table is read once.
    """
    if per is None:
        per = period_totals(sales, key, period)
    totals = materialize(per.groupBy(key).agg(F.sum("item_cnt_month").alias("item_cnt_day")))
    a = abc_from_totals(totals, key, **(abc_kw or {})).select(key, "abc")
    x = xyz_from_periods(per, key, period, **(xyz_kw or {})).select(key, "xyz")
    return a.join(x, on=key, how="inner")


def class_pairs(spark: SparkSession) -> DataFrame:
    """The nine (abc, xyz) pairs, a fixed 9-row domain."""
    return spark.createDataFrame([(a, x) for a in ABC_LABELS for x in XYZ_LABELS],
                                 "abc string, xyz string")


def abc_xyz_grid(classes: DataFrame, pivot: bool = False) -> DataFrame:
    """Number of keys per class pair, all nine pairs present.

    ``pivot=True`` gives the 3 x 3 matrix (one row per ABC class).
    """
    spark = classes.sparkSession
    counts = classes.groupBy("abc", "xyz").agg(F.count(F.lit(1)).alias("count"))
    grid = (class_pairs(spark).join(F.broadcast(counts), on=["abc", "xyz"], how="left")
            .select("abc", "xyz", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))
    if not pivot:
        return grid.orderBy("abc", "xyz")
    return (grid.groupBy("abc").pivot("xyz", list(XYZ_LABELS)).agg(F.sum("count"))
            .orderBy("abc"))


def revenue_by_key(sales: DataFrame, key: str = "item_id") -> DataFrame:
    """Exact revenue per key."""
    return sales.groupBy(key).agg(
        amount_to_double(sum_amount("item_price", "item_cnt_day")).alias("total_sale"))


def revenue_from_periods(per: DataFrame, key: str = "item_id") -> DataFrame:
    """A8 from a :func:`period_totals` table built ``with_revenue``."""
    return per.groupBy(key).agg(amount_to_double(F.sum("_amount")).alias("total_sale"))


def top_sales_in_class(classes: DataFrame, sales: DataFrame | None, items: DataFrame | None,
                       abc: str, xyz: str, k: int = 10, key: str = "item_id",
                       revenue: DataFrame | None = None) -> DataFrame:
    """The ``k`` keys with the most revenue inside one class pair.

    The class filter runs first, so only that pair's keys meet the revenue
    aggregate in the join. ``revenue`` (key, total_sale) may be given, e.g.
    from :func:`revenue_from_periods`, to avoid another fact scan.
    """
    chosen = classes.filter((F.col("abc") == abc) & (F.col("xyz") == xyz))
    if revenue is None:
        revenue = revenue_by_key(sales, key)
    joined = chosen.join(revenue, on=key, how="inner")
    cols = [key, "abc", "xyz", "total_sale"]
    if items is not None:
        joined = join_items(joined, items.select("item_id", "item_name", "item_category_id"))
        cols += ["item_name", "item_category_id"]
    return joined.select(*cols).orderBy(F.desc("total_sale"), F.asc(key)).limit(k)


def top_items_per_class(classes: DataFrame, items: DataFrame, units: DataFrame,
                        n: int = 10) -> DataFrame:
    """Up to ``n`` items per class pair, most units first, with names."""
    ranked = classes.join(units, on="item_id", how="inner")
    top = top_n_per_group(ranked, ["abc", "xyz"],
                          [F.desc("item_cnt_day"), F.asc("item_id")], n)
    return join_items(top, items.select("item_id", "item_name"))


def item_share_by_class(abc: DataFrame) -> DataFrame:
    """A17 on R5: the fraction of items in A, B and C."""
    return class_share(abc, "abc")

