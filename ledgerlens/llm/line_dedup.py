"""Deletion of repeated line runs, with DataFrame expressions only.

The line sequences of all documents are ranked by prefix doubling: rank 0 of
a position stands for its line, rank k+1 for the pair of ranks k at the
position and 2^k lines on, hence for the 2^(k+1) lines from there. Positions
of one rank form one interval of equal prefixes of the suffix order; an
interval of a single position retires it, so each round works on what is
still repeated, and the rounds end when nothing is. Ranks are 128-bit names:
only equality of prefixes is needed to find the intervals, not their order.

A run counts when it holds ``min_words`` words (a line without words counts
as one). For each line the shortest such run that starts there and the
shortest that ends there are looked up: two overlapping ranks of the run's
length name it exactly. A run that has an earlier copy (by doc_id, then line)
is deleted. The two families together cover exactly the lines of the maximal
repeated runs of at least ``min_words`` words, later copies only.

Counts per rank are folded map-side; joins back to a rank that a third of all
lines share are plain equi-joins that adaptive execution splits; ranks are
joined to each other by position, where no key is hot.

Defined cases: a null text has one empty line, as an empty text has; a null
``doc_id`` sorts first, and every row without an id is a document of its own;
rows that repeat both an id and the text are one document and lose the same
lines; an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, saved, text_of

MIN_WORDS = 10
_KEY = ["_d", "_t"]
_NULL_ID = -(2 ** 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_d, _t, _text``: the id, and what tells documents of one id apart (their
    text; the row itself where there is no id)."""
    fields = [F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")]
    rows = None
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            rows = docs.select(*fields, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
        except AnalysisException:  # a store that does not number its rows
            rows = None
    if rows is None:
        rows = saved(docs.select(*fields).withColumn("_row", F.monotonically_increasing_id()), "line-rows")
    return rows.select(F.coalesce("_id", F.lit(_NULL_ID)).alias("_d"),
                       F.when(F.col("_id").isNull(), F.col("_row")).otherwise(F.xxhash64("_text")).alias("_t"),
                       "_text")


def _names(*cols) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in ((1, "_a"), (2, "_b"))]


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose name occurs at two positions or more."""
    again = rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Written first, so that both sides of the join are plain shuffles, whose
    # hot keys adaptive execution can split.
    return rows.join(saved(again.select("_a", "_b"), "line-names"), ["_a", "_b"], "left_semi")


def rank_levels(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Ranks of repeated windows of 1, 2, 4, ... lines up to ``longest``."""
    levels = [saved(_repeated(lines.select(*_KEY, "_i", "_a", "_b")), "line-rank")]
    while 2 ** len(levels) <= longest:
        now, shift = levels[-1], 2 ** (len(levels) - 1)
        on = now.select(*_KEY, (F.col("_i") - shift).alias("_i"),
                        F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
        pairs = now.join(on, [*_KEY, "_i"]).select(*_KEY, "_i", *_names("_a", "_b", "_a2", "_b2"))
        nxt = saved(_repeated(pairs), "line-rank")
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return levels


def _shortest_runs(lines: DataFrame, words: int) -> DataFrame:
    """(_s, _len): for each line the shortest run of ``words`` words starting
    there and the shortest ending there, within its document."""
    w = Window.partitionBy(*_KEY).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    marks = lines.select(*_KEY, "_i", "_w",
                         F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_before"))
    ends = marks.select(*_KEY, (F.col("_i") + 1).alias("_at"),
                        (F.col("_before") + F.col("_w")).alias("_v"), F.lit(0).alias("_ask"))
    starts = marks.select(*_KEY, F.col("_i").alias("_at"), F.col("_before").alias("_v"),
                          F.lit(0).alias("_ask"))

    def nearest(answers: DataFrame, asks: DataFrame, falling: bool) -> DataFrame:
        order = ([F.desc("_v"), F.asc("_ask"), F.desc("_at")] if falling
                 else [F.asc("_v"), F.asc("_ask"), F.asc("_at")])
        seen = Window.partitionBy(*_KEY).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = F.last(F.when(F.col("_ask") == 0, F.col("_at")), ignorenulls=True).over(seen)
        return (answers.unionByName(asks).withColumn("_found", found)
                .filter("_ask = 1 and _found is not null"))

    forward = nearest(ends, marks.select(*_KEY, F.col("_i").alias("_at"),
                                         (F.col("_before") + words).alias("_v"),
                                         F.lit(1).alias("_ask")), falling=True)
    backward = nearest(starts, marks.select(*_KEY, (F.col("_i") + 1).alias("_at"),
                                            (F.col("_before") + F.col("_w") - words).alias("_v"),
                                            F.lit(1).alias("_ask")), falling=False)
    return (forward.select(*_KEY, F.col("_at").alias("_s"),
                           (F.col("_found") - F.col("_at")).alias("_len"))
            .unionByName(backward.select(*_KEY, F.col("_found").alias("_s"),
                                         (F.col("_at") - F.col("_found")).alias("_len")))
            .distinct())


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Runs that repeat an earlier one: ``_d, _t, _s, _len`` (first line, lines)."""
    return _later_runs(_keyed(docs, id_col, text_col), min_words)


def _later_runs(keyed: DataFrame, min_words: int) -> DataFrame:
    rows = keyed.select(
        *_KEY, F.posexplode(F.split("_text", "\n")).alias("_i", "_line"))
    lines = rows.select(*_KEY, "_i", F.greatest(F.regexp_count("_line", F.lit(WORD)), F.lit(1))
                        .cast("long").alias("_w"), *_names("_line")).dropDuplicates([*_KEY, "_i"])
    lines = saved(lines, "lines")
    levels = rank_levels(lines, min_words)
    # Written before the joins: pushed below the windows, they would drop the
    # rows that the windows look back on.
    runs = saved(_shortest_runs(lines, min_words), "line-shortest")
    # A run can only repeat if its first and last line do.
    ends = levels[0].select(*_KEY, "_i")
    runs = (runs.join(ends.withColumnRenamed("_i", "_s"), [*_KEY, "_s"], "left_semi")
            .withColumn("_e", F.col("_s") + F.col("_len") - 1)
            .join(ends.withColumnRenamed("_i", "_e"), [*_KEY, "_e"], "left_semi"))
    runs = saved(runs.drop("_e"), "line-runs")
    named = []
    for k, level in enumerate(levels):
        size = 2 ** k
        here = runs.filter((F.col("_len") >= size) & (F.col("_len") < 2 * size))
        head = level.withColumnRenamed("_i", "_s")
        tail = level.select(*_KEY, F.col("_i").alias("_j"), F.col("_a").alias("_a2"),
                            F.col("_b").alias("_b2"))
        named.append(here.join(head, [*_KEY, "_s"])
                     .withColumn("_j", F.col("_s") + F.col("_len") - size)
                     .join(tail, [*_KEY, "_j"])
                     .select(*_KEY, "_s", "_len", *_names("_len", "_a", "_b", "_a2", "_b2")))
    all_runs = named[0]
    for more in named[1:]:
        all_runs = all_runs.unionByName(more)
    all_runs = saved(all_runs, "line-named")
    place = F.struct("_d", "_t", "_s")
    first = (all_runs.groupBy("_a", "_b").agg(F.min(place).alias("_first"),
                                              F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    first = saved(first, "line-first")
    return (all_runs.join(first, ["_a", "_b"]).filter(place > F.col("_first"))
            .select(*_KEY, "_s", "_len"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, dropped_lines`` (ascending,
    0-based) and ``text`` without them (empty if every line goes)."""
    keyed = _keyed(docs, id_col, text_col)
    dropped = (_later_runs(keyed, min_words)
               .select(*_KEY, F.explode(F.sequence("_s", F.col("_s") + F.col("_len") - 1)).alias("_i"))
               .groupBy(*_KEY).agg(F.array_sort(F.collect_set("_i")).alias("_drop")))
    dropped = saved(dropped, "line-drops")
    none = F.array().cast("array<int>")
    out = (keyed.join(dropped, _KEY, "left")
           .withColumn("_drop", F.coalesce(F.transform("_drop", lambda x: x.cast("int")), none))
           .withColumn("_lines", F.split("_text", "\n")))
    # The kept lines are those of the gaps between dropped ones, in one pass.
    edges = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_lines")))
    gaps = F.filter(F.arrays_zip(edges.alias("a"), F.slice(edges, F.lit(2), F.size("_drop") + 1).alias("b")),
                    lambda g: g["b"] - g["a"] > 1)
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("_lines"), g["a"] + 2, g["b"] - g["a"] - 1)))
    return out.select(
        F.nullif(F.col("_d"), F.lit(_NULL_ID)).alias("doc_id"), F.size("_lines").alias("n_lines"),
        F.col("_drop").alias("dropped_lines"),
        F.when(F.size("_drop") == 0, F.col("_text")).otherwise(
            F.array_join(kept, "\n")).alias("text"))
