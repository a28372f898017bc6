"""Session defaults give way to explicit settings; scratch data is shared."""

import pytest

from ledgerlens import session


class _Remote:
    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Remote)


def test_explicit_settings_win(monkeypatch, spark):
    seen = {}

    class Builder:
        def __getattr__(self, name):
            def call(*args):
                if name == "config":
                    seen[args[0]] = args[1]
                return self
            return call

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    system = spark.sparkContext._jvm.System
    system.setProperty("spark.sql.adaptive.enabled", "false")
    system.clearProperty("spark.ui.retainedJobs")
    try:
        session.build_session("local[2]")
    finally:
        system.clearProperty("spark.sql.adaptive.enabled")
    assert "spark.sql.adaptive.enabled" not in seen and seen["spark.ui.retainedJobs"] == "100"
