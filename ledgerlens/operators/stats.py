"""Descriptive statistics: exact quantiles, trimming, histograms, densities.

Spark's exact ``percentile`` keeps every value of a group in one buffer. The
quantiles here are exact too (linear interpolation between order
statistics, as in pandas ``quantile`` and SQL ``quantile_cont``) but are
computed from per-value counts and a distributed prefix count, so a large
or hot group never sits in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import join_groups, broadcast_if_small, broadcast_if_subset_small
from ledgerlens.operators.selection import GRID, order_statistics
from ledgerlens.session import materialize

# Quantiles are rounded so that interpolation noise (~1e-13) cannot change a
# trim decision or a comparison.
QUANTILE_PLACES = 6


def _pname(p: float) -> str:
    return "q" + f"{p:.4f}".rstrip("0").rstrip(".").replace(".", "_")


def quantiles(df: DataFrame, value_col: str, probs: list[float],
              group_cols: list[str] | None = None, names: list[str] | None = None,
              places: int = QUANTILE_PLACES, buckets: int | None = None,
              prepared: bool = False) -> DataFrame:
    """Exact interpolated quantiles of ``value_col``, per group if given.

    One output row per group (one row in total without groups) with one
    column per probability, named by ``names`` or ``q0_95`` style.
    ``buckets``: shares of the first sketch (see :mod:`ledgerlens.operators.selection`).
    ``prepared=True`` says ``df`` is already materialized.
    """
    groups = list(group_cols or [])
    names = names or [_pname(p) for p in probs]
    if not prepared:
        df = materialize(df.select(*groups, value_col))
    found = order_statistics(df, value_col, probs, groups, buckets or GRID)
    outs = []
    for i, name in enumerate(names):
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        outs.append(F.round(lo + (hi - lo) * fr, places).alias(name))
    return found.select(*groups, *outs)


def quantile(df: DataFrame, value_col: str, p: float) -> Column:
    """The exact global quantile as a scalar-subquery Column."""
    return quantiles(df, value_col, [p], names=["q"]).select("q").scalar()


def _threshold(df: DataFrame, value_col: str, p: float) -> Column:
    """The global quantile of a written table as a literal, which a filter
    pushes into the scan (null if there is no value)."""
    found = quantiles(df, value_col, [p], names=["q"], prepared=True).first()
    return F.lit(found["q"] if found else None)


def trim_upper(df: DataFrame, value_col: str, p: float = 0.95) -> DataFrame:
    """rows whose value is at most the global ``p`` quantile. The rows are
    written once, so threshold and filter do not compute them twice; what
    comes back is a filter over that written table."""
    df = materialize(df)
    return df.filter(F.col(value_col) <= _threshold(df, value_col, p))


def above_quantile(df: DataFrame, value_col: str, p: float = 0.95) -> DataFrame:
    """F8: rows above the global ``p`` quantile (the outliers of F7)."""
    df = materialize(df)
    return df.filter(F.col(value_col) > _threshold(df, value_col, p))


def trim_upper_per_group(df: DataFrame, value_col: str, group_cols: list[str],
                         p: float = 0.95) -> DataFrame:
    """per group, keep rows at most that group's own ``p`` quantile."""
    df = materialize(df)
    q = quantiles(df, value_col, [p], group_cols, names=["_trim_q"], prepared=True)
    return (join_groups(df, broadcast_if_subset_small(q, df), group_cols)
            .filter(F.col(value_col) <= F.col("_trim_q")).drop("_trim_q"))


def describe(df: DataFrame, value_col: str, group_cols: list[str] | None = None,
             with_quartiles: bool = True, places: int = 6, prepared: bool = False) -> DataFrame:
    """Count, mean, sample std, min, (quartiles), max.

    Numbers stay numeric (``DataFrame.describe`` returns strings, and
    ``summary`` gives approximate quartiles). With quartiles the rows are
    written once and read for both parts (``prepared=True``: they are, or are a
    filter over written rows).
    """
    groups = list(group_cols or [])
    if with_quartiles and not prepared:
        df = materialize(df)
    v = F.col(value_col)
    base = df.groupBy(*groups).agg(
        F.count(v).alias("count"),
        F.round(F.avg(v), places).alias("mean"),
        F.round(F.stddev_samp(v), places).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    if not with_quartiles:
        return base
    q = quantiles(df, value_col, [0.25, 0.5, 0.75], groups, names=["p25", "p50", "p75"],
                  places=places, prepared=True)
    if groups:
        return join_groups(base, q, groups)
    # One scalar subquery for the three quartiles.
    qs = q.select(F.struct("p25", "p50", "p75")).scalar()
    return base.select("*", *[qs[c].alias(c) for c in ("p25", "p50", "p75")])


def histogram(df: DataFrame, value_col: str, width: float,
              group_cols: list[str] | None = None, prepared: bool = False) -> DataFrame:
    """Counts per ``width``-wide bin starting at the minimum.

    Only non-empty bins are returned. ``prepared=True`` as in :func:`describe`.
    """
    groups = list(group_cols or [])
    v = F.col(value_col)
    if not prepared:
        df = materialize(df)
    if groups:
        lo = materialize(df.groupBy(*groups).agg(F.min(value_col).alias("_h_min")))
        staged = join_groups(df, broadcast_if_small(lo), groups)
        origin = F.col("_h_min")
    else:
        staged = df
        origin = df.select(F.min(value_col)).scalar()
    w = F.lit(float(width))
    b = F.floor((v - origin) / w).cast("int")
    return (staged.filter(v.isNotNull())
            .groupBy(*groups, b.alias("bin"), origin.alias("_o"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(*groups, "bin",
                    F.round(F.col("_o") + F.col("bin") * w, 6).alias("bin_start"),
                    F.round(F.col("_o") + (F.col("bin") + 1) * w, 6).alias("bin_end"),
                    "count"))


def auto_bin_width(df: DataFrame, value_col: str) -> DataFrame:
    """One row with the automatic histogram layout of ``value_col``.

    numpy's ``auto`` rule: width = min(max(FD, sqrt / 2), Sturges) with the
    Freedman-Diaconis width 2 IQR n^-1/3, the square-root width
    range / sqrt(n) and the Sturges width range / (log2 n + 1). The bin count
    is ceil(range / width) (1 when the width is 0) and the bins are then
    spread evenly over the range.
    """
    q = quantiles(df, value_col, [0.25, 0.75], names=["_p25", "_p75"], prepared=True)
    v = F.col(value_col)
    base = df.filter(v.isNotNull()).agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    iqr = q.select(F.col("_p75") - F.col("_p25")).scalar()
    fd = F.lit(2.0) * iqr * F.pow(n, F.lit(-1.0 / 3))
    sturges = (hi - lo) / (F.log2(n) + F.lit(1.0))
    sqrt_w = (hi - lo) / F.sqrt(n)
    width = F.least(F.greatest(fd, sqrt_w / F.lit(2.0)), sturges)
    bins = F.when(width > 0, F.ceil((hi - lo) / width)).otherwise(F.lit(1)).cast("int")
    return base.select("n", "lo", "hi", bins.alias("bins"),
                       F.when(bins > 0, (hi - lo) / bins).alias("width"))


def histogram_auto(df: DataFrame, value_col: str) -> DataFrame:
    """Histogram with the automatic layout; the top edge is inclusive."""
    df = materialize(df)
    # A one-row layout, written once and read by the three scalars below.
    layout = materialize(auto_bin_width(df, value_col))
    lo = layout.select("lo").scalar()
    width = layout.select("width").scalar()
    bins = layout.select("bins").scalar()
    v = F.col(value_col)
    raw = F.floor((v - lo) / F.when(width > 0, width).otherwise(F.lit(1.0))).cast("int")
    b = F.least(raw, bins - 1)
    return (df.filter(v.isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin",
                    F.round(lo + F.col("bin") * width, 6).alias("bin_start"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_end"),
                    "count"))


def kernel_density(df: DataFrame, value_col: str, group_cols: list[str] | None = None,
                   grid_size: int = 200, cut: float = 3.0, places: int = 10,
                   reach: float = 9.0) -> DataFrame:
    """Gaussian kernel density on an even grid, per group.

    Bandwidth is Scott's rule (sample std * n^-1/5); the grid runs from
    ``min - cut*h`` to ``max + cut*h``. Values are first reduced to
    (value, count) pairs, then every distinct value is spread over the grid
    points within ``reach`` bandwidths of it (beyond 9 the kernel is below 3e-18)
    and summed per (group, point), map-side first: what is shuffled is groups x
    grid points per task. Position and norm of a point are added to the sums.
    """
    groups = list(group_cols or [])
    v = F.col(value_col)
    clean = materialize(df.filter(v.isNotNull()).select(*groups, v))
    stats = clean.groupBy(*groups).agg(
        F.count(v).alias("_k_n"), F.min(v).alias("_k_min"), F.max(v).alias("_k_max"),
        F.stddev_samp(v).alias("_k_sd"))
    stats = stats.withColumn("_k_h", F.col("_k_sd") * F.pow(F.col("_k_n"), F.lit(-0.2)))
    # A group without spread has no bandwidth: its points, all at its one
    # value, have a null density.
    stats = stats.withColumn("_k_h", F.coalesce(F.col("_k_h"), F.lit(0.0)))
    counts = clean.groupBy(*groups, v.alias("_k_v")).agg(F.count(F.lit(1)).alias("_k_c"))
    start = F.col("_k_min") - F.lit(cut) * F.col("_k_h")
    step = (F.col("_k_max") - F.col("_k_min") + F.lit(2 * cut) * F.col("_k_h")) / F.lit(grid_size - 1)
    norm = F.col("_k_n") * F.col("_k_h") * F.lit(math.sqrt(2 * math.pi))
    layout = stats.select(*groups, start.alias("_k_start"), step.alias("_k_step"), "_k_h",
                          norm.alias("_k_norm"))
    if groups:
        layout = broadcast_if_subset_small(layout, clean)
    x = F.col("_k_start") + F.col("point") * F.col("_k_step")
    u = F.try_divide(x - F.col("_k_v"), F.col("_k_h"))
    term = F.col("_k_c") * F.exp(F.lit(-0.5) * u * u)

    def with_layout(rows: DataFrame) -> DataFrame:
        if groups:
            return join_groups(rows, layout, groups)
        one = layout.select(F.struct("*")).scalar()
        return rows.select("*", *[one[c].alias(c) for c in layout.columns])

    # Points whose distance to the value is within the reach, one more at
    # either end for the rounding of the division.
    first = F.floor(F.try_divide(F.col("_k_v") - F.lit(reach) * F.col("_k_h") - F.col("_k_start"),
                                 F.col("_k_step")))
    last = F.ceil(F.try_divide(F.col("_k_v") + F.lit(reach) * F.col("_k_h") - F.col("_k_start"),
                               F.col("_k_step")))
    points = F.sequence(F.coalesce(F.greatest(first, F.lit(0)), F.lit(0)).cast("int"),
                        F.coalesce(F.least(last, F.lit(grid_size - 1)), F.lit(grid_size - 1)).cast("int"))
    near = with_layout(counts).select("*", F.explode(points).alias("point")).select(
        *groups, "point", term.alias("_k_term"))
    # Every point of every group is in the result, also far from all values.
    grid = layout.select(*groups, F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("point"),
                         F.when(F.col("_k_h") > 0, F.lit(0.0)).alias("_k_term"))
    sums = near.unionByName(grid).groupBy(*groups, "point").agg(F.sum("_k_term").alias("_k_sum"))
    return with_layout(sums).select(
        *groups, "point", F.round(x, places).alias("x"),
        F.round(F.try_divide("_k_sum", "_k_norm"), places).alias("density"))
