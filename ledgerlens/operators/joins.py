"""Joins of the star schema.

A table is broadcast on a hint only when the planner's estimate of its bytes is
within a fixed bound. Beyond it the join stays a shuffle join, and statistics
and adaptive execution (with skew-join splitting) pick the strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest table (estimated bytes, uncompressed or as stored) that is broadcast
# on a hint; far below what an executor holds.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def row_count(df: DataFrame) -> int:
    """Row count of a written, immutable intermediate table (answered from
    Parquet footers), remembered on the DataFrame object."""
    rows = getattr(df, "_ledgerlens_rows", None)
    if rows is None:
        rows = df.count()
        try:
            df._ledgerlens_rows = rows
        except AttributeError:
            pass
    return rows


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when the planner's size estimate, which for
    a written table comes from its files, is within ``max_bytes``; otherwise
    leave the choice to the planner and adaptive execution."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def broadcast_if_subset_small(df: DataFrame, superset: DataFrame,
                              max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when a table it is a subset of (e.g. the dimension it
    was filtered from) is within ``max_bytes``: the bound is proven without
    computing ``df`` itself."""
    return F.broadcast(df) if estimated_bytes(superset) <= max_bytes else df


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fact ⋈ dimension with a USING join (one key column in the result)."""
    return fact.join(broadcast_if_small(dim, max_bytes), on=on, how=how)


def join_items(log: DataFrame, items: DataFrame, how: str = "inner", **kw) -> DataFrame:
    """Sales rows with item name and category."""
    return join_dimension(log, items, "item_id", how, **kw)


def join_star(log: DataFrame, items: DataFrame, categories: DataFrame, **kw) -> DataFrame:
    """Sales rows with item and category attributes (inner joins)."""
    return join_dimension(join_items(log, items, **kw), categories, "item_category_id", **kw)


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (``IN (subquery)``)."""
    return df.join(keys, on=on, how="left_semi")


def join_groups(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Inner join on group columns in which a null group meets itself; the
    group columns of ``left`` are kept."""
    names = {g: f"_jg_{k}" for k, g in enumerate(groups)}
    other = right.withColumnsRenamed(names)
    on = [left[g].eqNullSafe(other[n]) for g, n in names.items()]
    return left.join(other, on).drop(*names.values())
