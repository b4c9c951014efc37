"""Streaming forms: the same expressions over a growing folder of pages or events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.urls import domain_key, normalize
from pagemill.operators.chunking import ChunkOptions, chunk
from pagemill.operators.extract import extract_pages
from pagemill.sources.pages import extract_results


def read(spark: SparkSession, folder: str, schema, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def page_chunks(pages: DataFrame, strategy: str = "Paragraph", options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of pages as they come: no state, so append output works."""
    return chunk(extract_pages(pages).where(F.length("text") > 0), strategy, options)


def first_visits(pages: DataFrame, time: str, url: str = "url", within: str = "1 day") -> DataFrame:
    """Pages whose normalized URL was not met within the given time: bounded state."""
    return pages.withColumn("key", normalize(F.col(url))).withWatermark(time, within).dropDuplicatesWithinWatermark(["key"])


def domain_counts(events: DataFrame, time: str, url: str, ok: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests and failures of each domain by time window; rows later than ``late`` are dropped."""
    by = F.window(time, window).alias("window")
    return events.withWatermark(time, late).groupBy(by, domain_key(F.col(url)).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(ok)).alias("failed"))


def event_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))


def of_type(events: DataFrame, kind: str | None, column: str = "event_type") -> DataFrame:
    """Subscription: the events of one type, or all."""
    return events if kind is None else events.where(F.col(column) == kind)


def write(out: DataFrame, folder: str, checkpoint: str, mode: str = "append", once: bool = True):
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start(folder)


def results(replies: DataFrame, **options) -> DataFrame:
    """Extraction of replies as they come, failures as rows: ``extract_results`` has no state, so append output works."""
    return extract_results(replies, **options)


PROGRESS = "job string, processed long, failed long, total long, percent double, complete boolean, updated timestamp"


def job_progress(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """(job, processed, failed, total, percent, complete, updated) after each batch that brings something for a job.

    ``events``: job, total, ok, ts.  The state is three numbers a job; it goes when the job is complete, or when
    other events are later than its last one by twice ``ttl``.
    """
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        processed, failed, total = state.get if state.exists else (0, 0, 0)
        latest = None
        for rows in batches:
            processed, failed = processed + len(rows), failed + int((~rows["ok"]).sum())
            total = max(total, int(rows["total"].max()))
            latest = rows["ts"].max() if latest is None else max(latest, rows["ts"].max())
        complete = processed >= total
        if complete:
            state.remove()
        else:
            state.update((processed, failed, total))
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame(
            {"job": [key[0]], "processed": [processed], "failed": [failed], "total": [total], "percent": [100.0 * processed / max(total, 1)], "complete": [complete], "updated": [latest]}
        )

    late = events.withWatermark("ts", ttl)
    return late.groupBy("job").applyInPandasWithState(step, PROGRESS, "processed long, failed long, total long", "append", GroupStateTimeout.EventTimeTimeout)


class ProgressListener(StreamingQueryListener):
    """Calls ``report(kind, rows)`` when a query starts, after every ``every`` rows and at its end."""

    def __init__(self, report, every: int = 10):
        self.report, self.every, self.rows, self.told = report, every, 0, 0

    def onQueryStarted(self, event):
        self.report("started", 0)

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            self.report("progress", self.rows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.report("completed", self.rows)
