import os

import pytest
from test_jobs import _setup

from ledgerlens import jobs
from ledgerlens.sources import publication, sinks


def _writers(df, *names):
    return {n: (lambda path: sinks.write_report(df, path)) for n in names}


def _values(spark, path):
    return sorted(r[0] for r in spark.read.option("header", True).csv(path).collect())


def test_a_run_that_dies_between_two_reports_is_not_seen(spark, tmp_dir):
    first, second = spark.range(3), spark.range(10, 12)
    assert publication.published(spark, tmp_dir) == {}
    publication.publish(spark, tmp_dir, _writers(first, "a", "b"))

    def dies(path):
        second.write.csv(path + "/part")
        raise InterruptedError

    with pytest.raises(InterruptedError):
        publication.publish(spark, tmp_dir, _writers(second, "a") | {"b": dies})
    now = publication.published(spark, tmp_dir)
    assert {n: _values(spark, p) for n, p in now.items()} == {n: ["0", "1", "2"] for n in "ab"}
    publication.publish(spark, tmp_dir, _writers(second, "a", "b", "c"))
    assert {n: _values(spark, p) for n, p in publication.published(spark, tmp_dir).items()} == {
        n: ["10", "11"] for n in "abc"}
    # The set read before is still whole.
    assert _values(spark, now["b"]) == ["0", "1", "2"]


def test_vacuum_keeps_the_newest_sets(spark, tmp_dir):
    runs = [publication.publish(spark, tmp_dir, _writers(spark.range(1), "a")) for _ in range(3)]
    with pytest.raises(ZeroDivisionError):
        publication.publish(spark, tmp_dir, {"a": lambda path: 1 / 0})
    assert runs == sorted(runs)
    assert publication.vacuum_runs(spark, tmp_dir, keep=1) == 2
    assert os.listdir(os.path.join(tmp_dir, publication.RUNS)) == [runs[-1]]
    assert _values(spark, publication.published(spark, tmp_dir)["a"]) == ["0"]
    assert publication.vacuum_runs(spark, tmp_dir, keep=5) == 0


def test_jobs_publish_their_outputs_together(spark, tmp_dir):
    table, items, cats = _setup(spark, tmp_dir)
    out = os.path.join(tmp_dir, "published")
    result = jobs.run_reports(spark, table, items, cats, out, together=True)
    now = publication.published(spark, out)
    assert set(now) == set(result)
    assert len(_values(spark, now["top_10_goods"])) == result["top_10_goods"].count() > 0
