"""Progress of jobs and of queries: state with timers, and metrics observed in the plan.

``job_monitor`` needs the RocksDB state store: set ``STATE_STORE`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PROGRESS = "job string, event string, processed long, failed long, total long, percent double, errors map<string,long>, updated timestamp"


class JobMonitor(StatefulProcessor):
    """A job's numbers in a value state, its errors by code in a map state, and a timer that closes it.

    ``ttl`` after a job's last event its timer goes off: a job that is not complete by then is reported as
    ``closed``, and the state goes.  By processing time the states also carry ``ttl`` themselves.
    """

    def __init__(self, ttl_ms: int, by_event_time: bool):
        self.ttl_ms, self.by_event_time = ttl_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.by_event_time else 2 * self.ttl_ms
        self.numbers = handle.getValueState("numbers", "processed long, failed long, total long, updated long, timer long", ttl)
        self.errors = handle.getMapState("errors", "code string", "n long", ttl)

    def _row(self, job: str, event: str, processed: int, failed: int, total: int, updated: int) -> pd.DataFrame:
        errors = {code[0]: n[0] for code, n in self.errors.iterator()}
        percent = 100.0 * processed / total if total else 0.0
        row = {"job": job, "event": event, "processed": processed, "failed": failed, "total": total, "percent": percent, "errors": errors, "updated": pd.Timestamp(updated, unit="us")}
        return pd.DataFrame([row])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.numbers.get() if self.numbers.exists() else None
        processed, failed, total, updated, timer = known or (0, 0, 0, 0, None)
        was_complete = bool(known) and processed >= total
        for part in rows:
            processed += len(part)
            failed += int(part["error_code"].notna().sum())
            total = max(total, int(part["total"].max()))
            updated = max(updated, int(part["ts"].max().value // 1000))
            for code, n in part["error_code"].dropna().value_counts().items():
                before = self.errors.getValue((code,))[0] if self.errors.containsKey((code,)) else 0
                self.errors.updateValue((code,), (before + int(n),))
        now = timerValues.getCurrentWatermarkInMs() if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        due = max(updated // 1000 if self.by_event_time else now, now) + self.ttl_ms
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.numbers.update((processed, failed, total, updated, due))
        yield self._row(key[0], "completed" if processed >= total and not was_complete else "progress", processed, failed, total, updated)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        processed, failed, total, updated, _ = self.numbers.get()
        if processed < total:
            yield self._row(key[0], "closed", processed, failed, total, updated)
        self.numbers.clear()
        self.errors.clear()

    def close(self) -> None:
        pass


def job_monitor(events: DataFrame, ttl: str = "1 hour", late: str = "1 hour", by_event_time: bool = True) -> DataFrame:
    """(job, event, processed, failed, total, percent, errors, updated) after each batch that brings something for a job.

    ``events``: job, total, error_code (null for a success), ts.  ``event`` is progress, completed (once, when all are
    processed) or closed (no event for ``ttl``, work left).  State: some numbers a job and a number for each
    error code of it, until ``ttl`` after its last event.
    """
    monitor = JobMonitor(int(pd.Timedelta(ttl).total_seconds() * 1000), by_event_time)
    named = events.select(F.col("job").cast("string").alias("job"), F.col("total").cast("long").alias("total"), F.col("error_code").cast("string").alias("error_code"), F.col("ts").cast("timestamp").alias("ts"))
    timed = named.withWatermark("ts", late) if by_event_time else named
    return timed.groupBy("job").transformWithStateInPandas(monitor, PROGRESS, "Append", "EventTime" if by_event_time else "ProcessingTime")


CHUNKS = "chunks"


def observed(df: DataFrame, name: str | Observation = CHUNKS, **metrics: Column) -> DataFrame:
    """``df`` with metrics that its plan counts as it runs: rows, and what ``metrics`` names."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])


class ChunkListener(StreamingQueryListener):
    """Reports a query's start, each time that another ``every`` observed rows are done, and its end.

    ``report(kind, rows, metrics)``: the rows are those of the ``observed`` frame of this name, chunks for instance, not
    input rows; metrics are the last batch's.  Queries of other names are passed over where ``query`` is given.
    """

    def __init__(self, report: Callable[[str, int, dict], None], every: int = 10, name: str = CHUNKS, query: str | None = None):
        self.report, self.every, self.name, self.query = report, every, name, query
        self.rows: dict[str, int] = {}
        self.told: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        if self.query is None or event.name == self.query:
            self.rows[str(event.id)] = self.told[str(event.id)] = 0
            self.report("started", 0, {})

    def onQueryProgress(self, event) -> None:
        run, seen = str(event.progress.id), event.progress.observedMetrics.get(self.name)
        if run not in self.rows or seen is None:
            return
        self.rows[run] += seen["rows"]
        if self.rows[run] - self.told[run] >= self.every:
            self.told[run] = self.rows[run]
            self.report("progress", self.rows[run], seen.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        rows = self.rows.pop(str(event.id), None)
        if rows is not None:
            self.told.pop(str(event.id))
            self.report("failed" if event.exception else "completed", rows, {})
