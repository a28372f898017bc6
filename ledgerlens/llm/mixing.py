"""Mixing sources to target weights by entropy balancing.

Every document gets a copy rate that is as close as possible, in relative
entropy over token mass, to its base rate, subject to: the tokens taken from
each source equal the source's target, and no rate exceeds ``cap``. The convex
dual has one variable per source; its solution is the exponential tilt

    rate(d) = min(cap, base(d) * exp(lambda(source of d)))

Each Newton step is one distributed aggregation over all documents (the
gradient and the curvature of the dual, per source, folded map-side), with
the step kept inside a bracket so it always converges. The rates are then
rounded to whole copies by error diffusion: documents are dealt into cohorts
of one source (a few thousand rows, so a source with a third of all rows is
many cohorts; ids and sizes that many rows share are dealt row by row), and
within a cohort, longest first, each document takes the copy count that best
cancels the cohort's running token error. A cohort's final error is at most
half of its shortest documents.

Up to ``MAX_SOURCES`` sources their totals and dual variables are held on the
driver; beyond it they are a table, and each Newton step a join with it.

Defined cases: a null or word-less text has size 0 and takes nothing; a null
source is a source of its own, ordered last; a source without words gets
target 0; null and repeated ids are separate rows; an empty table gives an
empty result; reruns agree (all choices hash ids and sizes); clashing extra
columns are ignored.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import ship
from ledgerlens.llm.common import saved, word_count
from ledgerlens.operators.joins import broadcast_if_small
from ledgerlens.operators.running import ordered_index

ship(__name__)

MAX_SOURCES = 100_000
COHORT_ROWS = 2_000
TOLERANCE = 1e-6
MAX_STEPS = 60


def cyclic_weights(sources: list, pattern: tuple = (5.0, 2.0, 1.0)) -> dict:
    """Weights dealt in turn over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s])
    ordered += [None] * (None in sources)
    return {s: pattern[i % len(pattern)] for i, s in enumerate(ordered)}


def _cyclic_table(sources: DataFrame, pattern: tuple = (5.0, 2.0, 1.0)) -> DataFrame:
    """:func:`cyclic_weights` of a table of sources, as its column ``_weight``."""
    placed = ordered_index(sources, "_source", "_source", out_col="_at", descending=False)
    turn = F.element_at(F.array(*map(F.lit, pattern)), (F.col("_at") % len(pattern) + 1).cast("int"))
    return placed.withColumn("_weight", turn).drop("_at")


cyclic_weights.on_table = _cyclic_table


def capped_targets(sizes: dict, weights: dict, cap: float, total: float | None = None) -> dict:
    """Share ``total`` (all sizes by default) by weight; a target stops at
    ``cap`` times its source's size and the excess is reshared by weight
    until none is above."""
    left = float(sum(sizes.values())) if total is None else float(total)
    open_, out = dict(weights), {}
    while open_:
        share = left / sum(open_.values()) if sum(open_.values()) > 0 else 0.0
        full = [s for s, w in open_.items() if w * share > cap * sizes[s]]
        if not full:
            return out | {s: w * share for s, w in open_.items()}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def _lookup(spark, lam: dict) -> DataFrame:
    """(source, dual variable) rows; at most MAX_SOURCES, the bound of the
    broadcast."""
    return F.broadcast(spark.createDataFrame(list(lam.items()), "_source string, _lam double"))


def balance(rows: DataFrame, targets: dict, cap: float) -> dict:
    """Dual variables per source by safeguarded Newton steps over ``rows``
    (``_source``, ``_size``, ``_base``)."""
    spark = rows.sparkSession
    lam = {s: 0.0 for s, t in targets.items() if t > 0}
    low, high = {s: -700.0 for s in lam}, {s: 700.0 for s in lam}
    done: set = set()
    for _ in range(MAX_STEPS):
        todo = {s: v for s, v in lam.items() if s not in done}
        if not todo:
            break
        raw = F.col("_base") * F.exp(F.col("_lam"))
        mass = _joined(rows, _lookup(spark, todo))
        sums = (mass.groupBy("_source")
                .agg(F.sum(F.col("_size") * F.least(raw, F.lit(cap))).alias("taken"),
                     F.sum(F.when(raw < cap, F.col("_size") * raw).otherwise(0.0)).alias("slope"))
                .collect())
        for r in sums:
            s, gap = r["_source"], targets[r["_source"]] - r["taken"]
            if abs(gap) <= TOLERANCE * targets[s]:
                done.add(s)
                continue
            if gap > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] + gap / r["slope"] if r["slope"] > 0 else math.inf * gap
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-12:
                done.add(s)
            lam[s] = step
    if len(done) < len(lam):
        warnings.warn(f"{len(lam) - len(done)} sources did not reach their target in {MAX_STEPS} steps")
    return lam


def _table_targets(sources: DataFrame, cap: float) -> DataFrame:
    """:func:`capped_targets` for a table of sources (``_source_size``, ``_weight``):
    the share a unit of weight gets rises until no further source is full."""
    total = sources.agg(F.sum("_source_size")).first()[0] or 0
    limit, share, last = F.lit(float(cap)) * F.col("_source_size"), None, -1
    while True:
        full = F.lit(False) if share is None else F.col("_weight") * share > limit
        r = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit).otherwise(0.0)).alias("taken"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        if r["n"] == last:
            return sources.withColumn("_target", F.when(full, limit).otherwise(F.col("_weight") * share))
        last, share = r["n"], (total - r["taken"]) / r["open"] if r["open"] else 0.0


def _table_balance(rows: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """:func:`balance` with a row of state a source (``_lam``, its bracket, ``_done``)."""
    state = sources.select("*", F.when(F.col("_target") > 0, 0.0).otherwise(-1e9).alias("_lam"),
                           F.lit(-700.0).alias("_low"), F.lit(700.0).alias("_high"),
                           (F.col("_target") <= 0).alias("_done"))
    state = saved(state, "mix-state")
    raw = F.col("_base") * F.exp(F.col("_lam"))
    gap = F.col("_target") - F.col("_taken")
    newton = F.col("_lam") + F.try_divide(gap, F.col("_slope"))
    for _ in range(MAX_STEPS):
        todo = state.filter(~F.col("_done")).select("_source", "_lam")
        if todo.isEmpty():
            return state
        sums = (_joined(rows, broadcast_if_small(todo)).groupBy("_source")
                .agg(F.sum(F.col("_size") * F.least(raw, F.lit(cap))).alias("_taken"),
                     F.sum(F.when(raw < cap, F.col("_size") * raw).otherwise(0.0)).alias("_slope"))
                .withColumnRenamed("_source", "_vs"))
        met = (state.join(sums, state["_source"].eqNullSafe(sums["_vs"]), "left").drop("_vs")
               .withColumn("_open", ~F.col("_done") & F.col("_taken").isNotNull()
                           & (F.abs(gap) > TOLERANCE * F.col("_target"))))
        met = (met.withColumn("_low", F.when(F.col("_open") & (gap > 0), F.col("_lam")).otherwise(F.col("_low")))
               .withColumn("_high", F.when(F.col("_open") & (gap <= 0), F.col("_lam")).otherwise(F.col("_high"))))
        step = F.when((newton > F.col("_low")) & (newton < F.col("_high")), newton).otherwise(
            (F.col("_low") + F.col("_high")) / 2)
        state = saved(met.withColumn("_lam", F.when(F.col("_open"), step).otherwise(F.col("_lam")))
                      .withColumn("_done", ~F.col("_open") | (F.col("_high") - F.col("_low") < 1e-12))
                      .select(*state.columns), "mix-state")
    missed = state.filter(~F.col("_done")).count()
    if missed:
        warnings.warn(f"{missed} sources did not reach their target in {MAX_STEPS} steps")
    return state


def _table_plan(rows: DataFrame, weights, cap: float) -> DataFrame:
    """What :func:`mix` needs of each source, where the sources are many."""
    if not hasattr(weights, "on_table"):
        raise ValueError(f"for more than {MAX_SOURCES} sources give the weights an ``on_table`` form "
                         "(DataFrame with _source to the same with _weight)")
    sources = saved(rows.groupBy("_source").agg(
        F.sum("_size").alias("_source_size"),
        F.ceil(F.count(F.lit(1)) / COHORT_ROWS).cast("long").alias("_cohorts")), "mix-sources")
    weighed = saved(weights.on_table(sources), "mix-weights")
    state = _table_balance(rows, _table_targets(weighed, cap), cap)
    return broadcast_if_small(state.select("_source", "_source_size", "_target", "_lam", "_cohorts"))


def _driver_plan(rows: DataFrame, totals: list, weights, cap: float) -> DataFrame:
    sizes = {r["_source"]: r["size"] for r in totals}
    targets = capped_targets(sizes, weights(list(sizes)), cap)
    lam = balance(rows, targets, cap)
    return F.broadcast(rows.sparkSession.createDataFrame(
        [(r["_source"], r["size"], float(targets[r["_source"]]), lam.get(r["_source"], -1e9),
          max(1, -(-r["n"] // COHORT_ROWS))) for r in totals],
        "_source string, _source_size long, _target double, _lam double, _cohorts long"))


def _joined(rows: DataFrame, values: DataFrame) -> DataFrame:
    v = values.withColumnRenamed("_source", "_vs")
    return rows.join(v, rows["_source"].eqNullSafe(v["_vs"])).drop("_vs")


def _diffuse(cap: float):
    def cohort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_tie", "_id"], ascending=[False, True, True],
                              kind="mergesort")
        size, rate = pdf["_size"].to_numpy(), pdf["_rate"].to_numpy()
        copies = np.floor(rate + 1e-9).astype("int64")
        error = 0.0
        for i, (z, f) in enumerate(zip(size.tolist(), (rate - copies).tolist())):
            if f > 1e-9 and z:
                error += z * f
                if error >= z / 2 and copies[i] + 1 <= cap:
                    copies[i] += 1
                    error -= z
        copies[size == 0] = 0
        return pdf.assign(_copies=copies)[["_rid", "_copies"]]
    return cohort


def _dealt(rated: DataFrame) -> DataFrame:
    """The rows with ``_cohort``: by id and size, so that reruns agree, and where
    more rows than a cohort holds share both, by row."""
    shared = saved(rated.groupBy("_tie").count().filter(F.col("count") > COHORT_ROWS).select(
        "_tie", F.lit(True).alias("_shared")), "mix-shared")
    place = F.when(F.col("_shared"), F.xxhash64("_tie", "_rid")).otherwise(F.col("_tie"))
    return rated.join(broadcast_if_small(shared), "_tie", "left").withColumn(
        "_cohort", F.pmod(place, F.col("_cohorts")))


def mix(docs: DataFrame, weights=cyclic_weights, cap: float = 3.0, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", base: Column | None = None,
        keep: tuple = ()) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, rate,
    copies, taken`` and the columns named in ``keep`` (read from ``docs``).

    ``weights`` maps the list of sources to a weight each (its ``on_table`` a
    table of them, for very many sources); ``base`` is the rate a document has
    before balancing (1 by default).
    """
    measured = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                           word_count(text_col).alias("_size"),
                           (base if base is not None else F.lit(1.0)).alias("_base"),
                           *[F.col(c).alias(f"_keep_{c}") for c in keep])
    measured = saved(measured.withColumn("_rid", F.monotonically_increasing_id()), "mix-rows")
    rows = measured.select("_rid", "_id", "_source", "_size", "_base")
    totals = rows.groupBy("_source").agg(F.sum("_size").alias("size"),
                                         F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    many = len(totals) > MAX_SOURCES
    plan = _table_plan(rows, weights, cap) if many else _driver_plan(rows, totals, weights, cap)
    rated = _joined(rows, plan).withColumn(
        "_rate", F.least(F.col("_base") * F.exp("_lam"), F.lit(float(cap))))
    dealt = _dealt(rated.withColumn("_tie", F.xxhash64("_id", "_size")))
    copies = (dealt.select("_source", "_cohort", "_rid", "_id", "_size", "_rate", "_tie")
              .groupBy("_source", "_cohort")
              .applyInPandas(_diffuse(cap), "_rid long, _copies long"))
    kept = measured.select("_rid", *[f"_keep_{c}" for c in keep])
    out = rated.join(copies, "_rid")
    if keep:
        out = out.join(kept, "_rid")
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"),
                      F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), F.col("_rate").alias("rate"),
                      F.col("_copies").alias("copies"),
                      (F.col("_copies") * F.col("_size")).alias("taken"),
                      *[F.col(f"_keep_{c}").alias(f"kept_{c}") for c in keep])


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as its copies say, with the
    columns of ``docs``."""
    cols = docs.columns
    mixed = mix(docs, keep=tuple(cols), **options)
    repeated = mixed.withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"kept_{c}").alias(c) for c in cols])
