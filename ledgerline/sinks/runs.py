"""History of runs: an append-only log of events, folded to the state of each run.

A run writes an event when it starts and one when it ends. Each event is a Parquet folder of
its own below the day of the run's start, named by run and event, so writers at the same time
never share a folder, nothing is rewritten, and an event that is half written has no file
that a reader sees. A run whose process is lost stays ``running``; ``stale_after`` names it.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

STARTED, FINISHED, FAILED = "started", "finished", "failed"
RUNNING, STALE = "running", "stale"

_EVENT = "run_id string, name string, event string, at timestamp, report string, detail string, figures map<string,bigint>"
EVENTS = f"{_EVENT}, day date"


class Run:
    """One run in the log at ``path``; see :func:`recorded_run`."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.run_id = uuid.uuid4().hex
        self.report: str | None = None
        self.figures: dict[str, int] = {}
        self.day: dt.date | None = None

    def record(self, event: str, detail: str | None = None) -> None:
        """Append an event. The folder of an event that was written already makes Spark
        raise, so a run has each event once."""
        now = dt.datetime.fromtimestamp(time.time(), dt.timezone.utc)
        self.day = self.day or now.date()
        row = [(self.run_id, self.name, event, now, self.report, detail, dict(self.figures))]
        folder = f"{self.path.rstrip('/')}/day={self.day.isoformat()}/{self.run_id}-{event}"
        self.spark.createDataFrame(row, _EVENT).coalesce(1).write.parquet(folder)


@contextmanager
def recorded_run(spark: SparkSession, path: str | None, name: str) -> Iterator[Run]:
    """Record the start of a run and its end: finished, or failed with the error, which
    goes on to the caller. Inside, ``report`` and ``figures`` of the run may be set.
    Without ``path`` nothing is written."""
    run = Run(spark, path or "", name)
    if path is None:
        yield run
        return
    run.record(STARTED)
    try:
        yield run
    except BaseException as error:
        run.record(FAILED, f"{type(error).__name__}: {error}")
        raise
    run.record(FINISHED)


def read_events(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """All events of the log, or those of runs started on ``since`` or later, of which only
    the folders of these days are read. A log that no run has written is empty."""
    reader = spark.read.schema(EVENTS).option("basePath", path).option("recursiveFileLookup", "false")
    try:
        events = reader.parquet(f"{path.rstrip('/')}/day=*/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENTS)
    return events if since is None else events.filter(F.col("day") >= F.lit(since))


def run_states(events: DataFrame, stale_after: dt.timedelta | None = None) -> DataFrame:
    """A row per run: ``run_id, name, status, started_at, ended_at, report, detail,
    figures``. One hash aggregate by run. A run with an end has that status, a failure
    before a finish; one without is ``running``, or ``stale`` when it started longer ago
    than ``stale_after``. An end whose start was lost still counts."""
    ended = F.col("event") != STARTED
    # Of two ends the failure stands, as "failed" sorts before "finished".
    last = F.min_by(F.when(ended, F.struct("event", "at", "report", "detail", "figures")), F.when(ended, F.col("event")))
    folded = events.groupBy("run_id").agg(
        F.min("name").alias("name"), F.min(F.when(~ended, F.col("at"))).alias("started_at"), last.alias("last"),
    )
    waiting = F.lit(RUNNING)
    if stale_after is not None:
        oldest = F.current_timestamp() - F.lit(stale_after)
        waiting = F.when(F.col("started_at") < oldest, F.lit(STALE)).otherwise(waiting)
    return folded.select(
        "run_id", "name", F.coalesce("last.event", waiting).alias("status"), "started_at",
        F.col("last.at").alias("ended_at"), "last.report", "last.detail", "last.figures",
    )
