"""Reports published together: a reader meets the whole set of one run, never
a half-written report or reports of two runs.

Every run writes its reports into a folder of its own, ``runs/<run>`` below the
root. When all of them are written one small file, ``_manifests/<run>.json``, is
put in place by a rename and names them: that is the switch. The newest
manifest is what readers follow, so a run that dies between two reports leaves
what was published before as it was. Runs are numbered; two that finish at once
both leave a whole set, and the greater name counts.

:func:`vacuum_runs` deletes what readers no longer follow.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ledgerlens.sources.ledger import _delete, _names, _write_whole

RUNS, MANIFESTS = "runs", "_manifests"


def _published_runs(spark: SparkSession, root: str) -> list[str]:
    return [n.removesuffix(".json") for n in _names(spark, f"{root}/{MANIFESTS}") if n.endswith(".json")]


def publish(spark: SparkSession, root: str, writers: dict[str, Callable[[str], object]]) -> str:
    """Call each writer with the folder its report goes to, then switch to the
    new set; returns the run's name. What a writer raises passes through, and
    nothing is switched."""
    known = [*_published_runs(spark, root), *_names(spark, f"{root}/{RUNS}")]
    number = 1 + max((int(n.split("-")[0]) for n in known), default=0)
    run = f"{number:012d}-{uuid.uuid4().hex}"
    for name, write in writers.items():
        write(f"{root}/{RUNS}/{run}/{name}")
    _write_whole(spark, f"{root}/{MANIFESTS}/{run}.json",
                 json.dumps({"run": run, "reports": sorted(writers)}))
    return run


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of each report of the newest published set; empty before the first."""
    runs = _published_runs(spark, root)
    if not runs:
        return {}
    text = spark.read.text(f"{root}/{MANIFESTS}/{runs[-1]}.json", wholetext=True).first()[0]
    manifest = json.loads(text)
    return {name: f"{root}/{RUNS}/{manifest['run']}/{name}" for name in manifest["reports"]}


def vacuum_runs(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all runs older than the ``keep`` newest published ones, those that
    died included; returns how many. Call it when no run that old is still
    writing or being read."""
    runs = _published_runs(spark, root)
    if len(runs) < keep:
        return 0
    oldest_kept = runs[-keep]
    # Manifests first: a set that is named is always there as a whole.
    for run in runs[:-keep]:
        _delete(spark, f"{root}/{MANIFESTS}/{run}.json")
    gone = [r for r in _names(spark, f"{root}/{RUNS}") if r < oldest_kept]
    for run in gone:
        _delete(spark, f"{root}/{RUNS}/{run}")
    return len(gone)
