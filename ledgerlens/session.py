"""Session construction and lineage helpers.

Cluster settings (executor count, memory, shuffle partitions) come from the
submitting environment; the defaults below only fill what is unset so the same
code runs under ``spark-submit`` and in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. They are applied with setIfMissing
# semantics: an explicit cluster value always wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dates are derived from timestamps without a zone; pin the session zone
    # so day boundaries do not move with the cluster's locale.
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The analyses run many short jobs; keep the driver's status store small
    # and its per-query plan text cheap.
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
    "spark.sql.ui.explainMode": "simple",
}


def build_session(master: str | None = None, app_name: str = "ledgerlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the package defaults applied where unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # What spark-submit or a properties file set explicitly is in the JVM's
    # system properties, which a fresh SparkConf reads.
    SparkContext._ensure_initialized()
    given = SparkConf()
    for key, value in _DEFAULTS.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is read as is.
    Only when it is unset on a local master (tests) a scratch folder is
    created; on a cluster that is an error, as executors do not share one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under the shared
    checkpoint folder. Everything one run writes sits below it, so a
    finished application's intermediates can be removed as one folder."""
    return os.path.join(checkpoint_dir(spark), "ledgerlens",
                        spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under this application's scratch folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote under its scratch folder. Call it
    when nothing reads its tables any more (the end of a job)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back.

    The files live on the cluster's shared storage, so the result survives
    the loss of any executor (unlike a local checkpoint). Reading back gives
    a fresh relation with file statistics, which later joins use to decide
    a broadcast, and fresh column identities, so self-joins of the result
    plan cleanly.
    """
    spark = df.sparkSession
    path = scratch(spark, name or "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
