"""Order statistics by distributed selection: no sort and no prefix sum over
all rows, globally or per group.

1. One pass sketches every group's values at ``GRID`` even shares. The sketch
   errs by a tenth of a grid cell at most, so the cells around a wanted rank
   surely hold it.
2. Further passes, only while a group still has more than ``FINISH`` rows in
   those cells, sketch the cells alone, each some ``GRID / 5`` times narrower.
3. In one more pass rows in the cells are counted per value, rows between
   them per gap, and the wanted ranks are read off a running count of these.

Nothing is bounded by a number of ranges: what a task holds is a sketch of
fixed size per group, and the counts of one group's cells. Expressions are
handed over as SQL texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import broadcast_if_small, join_groups
from ledgerlens.session import materialize

GRID = 200
# Rows of a group's cells that one task ranks.
FINISH = 1_000_000


def _sketch(value: str, grid: int = GRID) -> str:
    shares = ", ".join(f"{k / grid!r}D" for k in range(grid + 1))
    return f"percentile_approx({value}, array({shares}), {10 * grid})"


def _ranks(n: str, p: float) -> tuple[str, str]:
    """The 0-based ranks around share ``p`` of ``n`` values."""
    return tuple(f"{f}(({n} - 1) * {float(p)!r}D)" for f in ("floor", "ceil"))


def _cell(sketch: str, low: str, high: str, n: str, i: int, grid: int = GRID) -> list[str]:
    """Bounds surely not above the value at rank ``low`` of ``n``, and not
    below that at ``high``."""
    return [f"{sketch}[int(greatest(floor(({low}) / {n} * {grid}) - 2, 0))] AS _s_lo{i}",
            f"{sketch}[int(least(ceil(({high} + 1) / {n} * {grid}) + 2, {grid}))] AS _s_hi{i}"]


class _Cells:
    """Per group the number of values and the bounds of each rank's cell: a
    written table, or without groups one row held by the driver."""

    def __init__(self, found: DataFrame, groups: list[str], k: int):
        self.groups, self.k = groups, k
        if groups:
            self.table = materialize(found)
            self.most = self.table.agg(F.max("_s_n")).first()[0] or 0
        else:
            self.row = found.first()
            self.most = self.row["_s_n"]

    def beside(self, rows: DataFrame, value_type) -> DataFrame:
        if self.groups:
            return join_groups(rows, broadcast_if_small(self.table), self.groups)
        bounds = {f"_s_{e}{i}": F.lit(self.row[f"_s_{e}{i}"]).cast(value_type)
                  for i in range(self.k) for e in ("lo", "hi")}
        return rows.withColumns({"_s_n": F.lit(self.row["_s_n"]), **bounds})


def _narrowed(held: DataFrame, v: str, groups: list[str], probs: list[float]) -> DataFrame:
    """Narrower cells, by a sketch of the rows in each."""
    aggs = ["first(_s_n) AS _s_n"]
    for i in range(len(probs)):
        inside = f"{v} BETWEEN _s_lo{i} AND _s_hi{i}"
        aggs += [f"count_if({v} < _s_lo{i}) AS _s_under{i}", f"count_if({inside}) AS _s_in{i}",
                 _sketch(f"CASE WHEN {inside} THEN {v} END") + f" AS _s_q{i}"]
    bounds = []
    for i, p in enumerate(probs):
        low, high = (f"{r} - _s_under{i}" for r in _ranks("_s_n", p))
        bounds += _cell(f"_s_q{i}", low, high, f"_s_in{i}", i)
    return held.groupBy(*groups).agg(*map(F.expr, aggs)).select(*groups, "_s_n", *map(F.expr, bounds))


def order_statistics(df: DataFrame, value_col: str, probs: list[float],
                     group_cols: list[str] | None = None, grid: int = GRID) -> DataFrame:
    """Per group (one row in all without groups, of NULLs for no values): the
    groups and, for probability ``i``, the values ``_lo<i>`` and ``_hi<i>`` at
    the ranks around ``(n - 1) * p`` with the fraction ``_fr<i>`` between them.
    ``df`` is written; NULL values do not count, a NULL group is a group. ``grid``
    is the number of shares of the first sketch."""
    groups, k, v = list(group_cols or []), len(probs), f"`{value_col}`"
    kind = df.schema[value_col].dataType
    rows = df.filter(F.col(value_col).isNotNull()).select(*groups, value_col)
    bounds = [b for i, p in enumerate(probs) for b in _cell("_s_q", *_ranks("_s_n", p), "_s_n", i, grid)]
    cells = _Cells(rows.groupBy(*groups).agg(F.expr(f"count({v}) AS _s_n"), F.expr(f"{_sketch(v, grid)} AS _s_q"))
                   .select(*groups, "_s_n", *map(F.expr, bounds)), groups, k)
    left = cells.most * min(1.0, 5 / grid)
    while left > FINISH:
        cells = _Cells(_narrowed(cells.beside(rows, kind), v, groups, probs), groups, k)
        left = left * 5 / GRID
    held = cells.beside(rows, kind)
    # The gaps and cells in ascending order: a value's section is the number
    # of cells that end below it; a section's gap comes before its cells.
    section = " + ".join(f"int({v} > _s_hi{i})" for i in range(k))
    inside = " OR ".join(f"{v} BETWEEN _s_lo{i} AND _s_hi{i}" for i in range(k))
    counted = held.groupBy(*groups, F.expr(section).alias("_s_part"),
                           F.expr(f"CASE WHEN {inside} THEN {v} END").alias("_s_v")).agg(
        F.count(F.lit(1)).alias("_s_c"))
    part = f"PARTITION BY {', '.join(f'`{g}`' for g in groups)} " if groups else ""
    ranked = counted.select(*groups, "_s_v", "_s_c", *map(F.expr, (
        f"sum(_s_c) OVER ({part}ORDER BY _s_part, _s_v NULLS FIRST "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _s_upto",
        f"sum(_s_c) OVER ({part}) AS _s_all" if part else "sum(_s_c) OVER () AS _s_all")))
    picks = ["max(_s_all) AS _s_all"]
    for i, p in enumerate(probs):
        for name, rank in zip(("lo", "hi"), _ranks("_s_all", p)):
            picks.append(f"max(CASE WHEN _s_upto - _s_c <= {rank} AND {rank} < _s_upto THEN _s_v END) AS _{name}{i}")
    found = ranked.groupBy(*groups).agg(*map(F.expr, picks))
    missing = " OR ".join(f"_lo{i} IS NULL OR _hi{i} IS NULL" for i in range(k))
    checked = f"CASE WHEN _s_all > 0 AND ({missing}) THEN raise_error('a rank outside its cells') END"
    fractions = [f"(_s_all - 1) * {float(p)!r}D - {_ranks('_s_all', p)[0]} AS _fr{i}"
                 for i, p in enumerate(probs)]
    return found.select(*groups, *[f"_{e}{i}" for i in range(k) for e in ("lo", "hi")],
                        *map(F.expr, fractions), F.expr(checked).alias("_s_checked")).filter(
        "_s_checked IS NULL").drop("_s_checked")
