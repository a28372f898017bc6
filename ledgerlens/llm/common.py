"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.joins import broadcast_if_small
from ledgerlens.session import materialize

# ASCII white space (space, tab, line feed, vertical tab, form feed, carriage
# return) and its complement, as Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back."""
    return materialize(df, name)


def row_keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``_row``, a long of its own for every row that stays the same
    when the rows are read again: the place in its file where ``df`` is a table
    of files read as it is, else a number written once with the rows."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias("_file"),
                               F.col("_metadata.row_index").alias("_place"))
        except AnalysisException:  # a store that does not number its rows
            placed = None
        if placed is not None:
            files = sorted(r[0] for r in placed.select("_file").distinct().collect())
            numbers = df.sparkSession.createDataFrame(
                [(f, n << 40) for n, f in enumerate(files)], "_file string, _base long")
            return (placed.join(F.broadcast(numbers), "_file")
                    .withColumn("_row", F.col("_base") + F.col("_place"))
                    .select(*df.columns, "_row"))
    return saved(df.withColumn("_row", F.monotonically_increasing_id()), name)


def text_volume(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text, to size the number of groups a stage works in."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch, so a batch of very long texts still
    fits beside a worker's other arrays. A smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def least_hashed(rows: DataFrame, group: str, mark: str, most: int) -> DataFrame:
    """At most ``most`` distinct values of ``mark`` (a long hash) of each
    ``group``, the least ones by hash; nulls are left out.

    A group's number of distinct marks is estimated first (a sketch, folded
    map-side); only marks hashing below about four times the wanted share are
    ranked, so the rows that meet in a group's task are a few times ``most``,
    however large the group and however often a mark repeats.
    """
    share = F.shiftrightunsigned(F.xxhash64(mark), 1) / F.lit(float(2 ** 63))
    known = rows.filter(F.col(mark).isNotNull() & F.col(group).isNotNull()).select(group, mark)
    sizes = saved(known.groupBy(F.col(group).alias("_group")).agg(
        F.approx_count_distinct(mark, 0.05).alias("_marks")), "sample-sizes")
    near = (known.join(broadcast_if_small(sizes), F.col(group) == F.col("_group"))
            .filter(share * F.col("_marks") < 4 * most).select(group, mark).distinct())
    order = Window.partitionBy(group).orderBy(share, mark)
    return (near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
            .drop("_rank"))
