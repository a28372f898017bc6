"""Exact deduplication that no group of copies can overload.

Texts are equal when they are identical after every run of ASCII white space
is replaced by one space. Three combining stages, each grouping by the digest
*and the whole normalised text*, so a digest collision can never merge texts:

1. local: the map side of the first aggregation folds a task's copies;
2. salted: a digest that holds more than ``1 / HEAVY_SHARE`` of the rows is
   dealt over ``salts`` groups by a hash of the row id;
3. global: only the winners of the salted groups of heavy digests are merged.

The heavy digests number at most ``HEAVY_SHARE`` whatever the input, which is
what bounds their broadcast. Rows are joined to their group by digest and
salt, so the join has no hot key either.

Defined cases: a null text counts as empty; a null ``doc_id`` sorts before
every other id (it wins its group, and ``keep_id`` is then null); rows that
repeat an id are separate rows, of which all that carry the winning id are
marked kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, saved, text_of

# At most this many digests can each hold more than 1 / HEAVY_SHARE of the
# rows: the bound on the broadcast list.
HEAVY_SHARE = 10_000
# A digest with fewer rows than this is never worth dealing out.
HEAVY_ROWS = 256
SALTS = 256

# Stands for a null id inside the aggregates (sorts first).
_NULL_ID = -(2 ** 63)


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"),
                       normalised(text_col).alias("_text"))
    rows = rows.select("_id", "_text",
                       F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"),
                       F.xxhash64("_text").alias("_tag"))
    marks = saved(rows.select("_id", "_sha", "_tag"), "exact-marks")

    n = marks.count()
    heavy = (marks.groupBy("_sha").count()
             .filter(F.col("count") > max(HEAVY_ROWS, n // HEAVY_SHARE))
             .select("_sha", F.lit(True).alias("_heavy")))
    heavy = saved(heavy, "exact-heavy")

    def salted(df: DataFrame) -> DataFrame:
        salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64("_id"), F.lit(salts))).otherwise(F.lit(-1))
        return df.join(F.broadcast(heavy), "_sha", "left").withColumn("_salt", salt).drop("_heavy")

    key = ["_sha", "_tag"]
    # Stages 1 and 2: Spark folds each task's copies before the shuffle, then
    # merges them per (digest, salt, text).
    winners = (salted(rows).groupBy(*key, "_salt", "_text")
               .agg(F.min("_id").alias("_win"), F.count(F.lit(1)).alias("_n"))
               .withColumn("_text", F.when(F.col("_salt") >= 0, F.col("_text"))))
    winners = saved(winners, "exact-winners")
    plain = winners.filter("_salt < 0").select(*key, "_salt", F.col("_win").alias("_keep"),
                                               F.col("_n").alias("_size"))
    # Stage 3: the winners of dealt-out digests meet.
    dealt = winners.filter("_salt >= 0")
    merged = dealt.groupBy(*key, "_text").agg(F.min("_win").alias("_keep"),
                                              F.sum("_n").alias("_size"))
    dealt = (dealt.select(*key, "_salt", "_text")
             .join(merged, on=[*key, "_text"]).select(*key, "_salt", "_keep", "_size"))
    # Two texts under one (sha256, xxhash64, salt) would make the join below
    # ambiguous; that is reported, never resolved by guessing.
    groups = (plain.unionByName(dealt).groupBy(*key, "_salt")
              .agg(F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"),
                   F.max("_size").alias("_size")))
    checked = F.when(F.col("_texts") == 1, F.col("_size")).otherwise(
        F.raise_error(F.lit("two different texts share both digests")).cast("long"))
    out = salted(marks).join(groups.withColumn("_size", checked), on=[*key, "_salt"])

    def back(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(_NULL_ID))

    return out.select(
        back("_id").alias("doc_id"), back("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"), (F.col("_id") == F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
