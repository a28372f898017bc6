"""Running sums and row positions without a single-partition window.

A window with ORDER BY and no PARTITION BY sends every row to one task. The
functions here compute the same exact values in a distributed way:

1. range-partition the rows by the ordering columns themselves, whatever their
   types (Spark samples the boundaries), sort each range, and write the rows
   with their range and their place in it (:func:`split_ranges`). Rows that
   are equal in all ordering columns may be split too, so no value or key,
   however hot, fills a range of its own;
2. total per range: at most one row a range and group;
3. running offset of each range: a window over those few rows;
4. the value inside a range, from its place or from a window partitioned by
   range, plus the range's offset.

The number of ranges is the session's number of shuffle partitions, coalesced
by adaptive execution; nothing else bounds it. NULL values come last, in
either direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.joins import broadcast_if_subset_small, join_groups
from ledgerlens.session import materialize

BUCKET, AT = "_lr_bucket", "_lr_at"
# monotonically_increasing_id: the partition above this many bits of row number.
_PLACE_BITS = 33


def split_ranges(df: DataFrame, orders: list[Column], ranges: int | None = None) -> DataFrame:
    """The rows of a written table in the order ``orders``, written again with
    ``_lr_bucket`` (their range, rising in that order) and ``_lr_at`` (a number
    that rises by one from row to row of a range)."""
    tie = "_lr_tie"
    rows = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [*orders, F.asc(tie)]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumn(AT, F.monotonically_increasing_id())
    bucket = F.shiftright(AT, _PLACE_BITS).cast("int")
    return materialize(placed.drop(tie).withColumn(BUCKET, bucket))


def _direction(col: str, descending: bool) -> Column:
    return F.desc_nulls_last(col) if descending else F.asc_nulls_last(col)


def _with_offsets(staged: DataFrame, per_range: DataFrame, parts: list[str], total: str,
                  offset: str) -> DataFrame:
    """``staged`` joined to its range's row of ``per_range``, with the sum of
    ``total`` over the earlier ranges (of the group) as ``offset``."""
    earlier = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn(offset, F.sum(total).over(earlier))
    # Without groups one row a range; else at most one more for each group.
    offsets = F.broadcast(offsets) if not parts else broadcast_if_subset_small(offsets, staged)
    return join_groups(staged, offsets, [*parts, BUCKET])


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out_col: str = "cumsum",
               partition_cols: list[str] | None = None, descending: bool = True,
               tie_col: str | None = None, buckets: int | None = None,
               prepared: bool = False) -> DataFrame:
    """Inclusive running sum of ``value_col`` within ``partition_cols``.

    Rows are traversed by ``order_col`` (descending by default, NULL last), then
    by ``tie_col`` ascending. The (partition, order, tie) combination should be
    unique; for RANGE semantics over repeated values aggregate them first
    (see :func:`running_total`). As in a plain window NULL values add nothing,
    and a sum of NULLs alone is NULL. ``prepared=True`` says ``df`` is already
    materialized.
    """
    parts = list(partition_cols or [])
    if not prepared:
        # The boundary sample and the sort both read it.
        df = materialize(df)
    orders = [_direction(order_col, descending)] + ([F.asc(tie_col)] if tie_col else [])
    staged = split_ranges(df, [*[F.asc(p) for p in parts], *orders], buckets)
    per_range = staged.groupBy(*parts, BUCKET).agg(F.sum(value_col).alias("_lr_sum"))
    w = (Window.partitionBy(*parts, BUCKET).orderBy(*orders, AT)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.sum(value_col).over(w)
    return _with_offsets(staged, per_range, parts, "_lr_sum", "_lr_off").select(
        *df.columns, F.coalesce(F.col("_lr_off") + inside, inside, F.col("_lr_off")).alias(out_col))


def running_total(totals: DataFrame, value_col: str, key_col: str,
                  out_col: str = "cumsum", frame: str = "range",
                  buckets: int | None = None, prepared: bool = False) -> DataFrame:
    """Running sum of ``value_col`` in descending order, one row per key.

    ``frame="range"``: rows with equal values share one running value (the
    default frame of ``sum() OVER (ORDER BY v DESC NULLS LAST)``).
    ``frame="rows"``: row by row, ties broken by ``key_col`` ascending.
    A key whose value is NULL comes last and has the sum of all values.
    """
    v = value_col
    if frame == "rows":
        return prefix_sum(totals, v, v, out_col, tie_col=key_col, buckets=buckets,
                          prepared=prepared)
    if frame != "range":
        raise ValueError(f"unknown frame {frame!r}")
    # One row per key, written once: it feeds the distinct values and the join.
    if not prepared:
        totals = materialize(totals)
    # One row per distinct value: hot values collapse before any window.
    distinct_values = materialize(totals.groupBy(v).agg(F.sum(v).alias("_rt_s")))
    cum = prefix_sum(distinct_values, v, "_rt_s", out_col, buckets=buckets, prepared=True)
    # The written distinct-value table bounds the prefix sums' size.
    return join_groups(totals, broadcast_if_subset_small(cum.select(v, out_col), distinct_values),
                       [v])


def position_within(df: DataFrame, group_cols: list[str], order_col: str,
                    out_col: str = "position", buckets: int | None = None,
                    prepared: bool = False) -> DataFrame:
    """1-based position of each row inside its group, ordered by ``order_col``.

    Equivalent to ``row_number() OVER (PARTITION BY group ORDER BY order_col
    NULLS LAST)``, but a group holding a large share of the rows is split
    into ranges, so no single task sorts the whole group.
    """
    if not prepared:
        df = materialize(df)
    staged = split_ranges(df, [*[F.asc(g) for g in group_cols], F.asc_nulls_last(order_col)], buckets)
    # A group's rows in a range follow each other, from its least place on.
    per_range = staged.groupBy(*group_cols, BUCKET).agg(F.count(F.lit(1)).alias("_pw_n"),
                                                        F.min(AT).alias("_pw_first"))
    place = F.coalesce("_pw_off", F.lit(0)) + F.col(AT) - F.col("_pw_first") + 1
    return _with_offsets(staged, per_range, group_cols, "_pw_n", "_pw_off").select(
        *df.columns, place.alias(out_col))


def ordered_index(df: DataFrame, order_col: str, key_col: str, out_col: str = "index",
                  descending: bool = True, buckets: int | None = None,
                  prepared: bool = False) -> DataFrame:
    """0-based position of each row in the order (``order_col``, then
    ``key_col`` ascending), NULL values last, for columns of any ordered type."""
    if not prepared:
        df = materialize(df)
    staged = split_ranges(df, [_direction(order_col, descending), F.asc(key_col)], buckets)
    per_range = staged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_oi_n"),
                                           F.min(AT).alias("_oi_first"))
    place = F.coalesce("_oi_off", F.lit(0)) + F.col(AT) - F.col("_oi_first")
    return _with_offsets(staged, per_range, [], "_oi_n", "_oi_off").select(
        *df.columns, place.alias(out_col))


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list,
                    n: int = 10, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per group (Catalyst plans a map-side group limit)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rn = "_tn_rank" if rank_col is None else rank_col
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out.drop(rn) if rank_col is None else out
