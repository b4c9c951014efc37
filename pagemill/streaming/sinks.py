"""Sinks of streams: results and failures written once each, and events dealt to subscribers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Handler = Callable[[DataFrame, int], None]


def outcome(error: str = "error_code"):
    return F.when(F.col(error).isNull(), "result").otherwise("failure")


def write_batch(batch: DataFrame, batch_id: int, folder: str, error: str = "error_code") -> None:
    """Write a batch to ``batch=N/outcome=result`` and ``outcome=failure`` in one pass.

    Only the batch's own partitions are replaced, when the job commits: a batch that is run again after a
    failure or a restart leaves the same files as one that ran once.
    """
    routed = batch.withColumns({"batch": F.lit(batch_id).cast("long"), "outcome": outcome(error)})
    routed.write.partitionBy("batch", "outcome").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def sink(results: DataFrame, folder: str, checkpoint: str, once: bool = True, error: str = "error_code"):
    """Start writing a stream of results with their failures as rows; each batch exactly once."""
    writer = results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write_batch(batch, n, folder, error))
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_sink(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What ``sink`` wrote: the results' columns, ``batch`` and ``outcome``."""
    fields = spark.createDataFrame([], schema).schema.add("batch", "long").add("outcome", "string")
    return spark.read.schema(fields).option("basePath", folder).parquet(folder)


def session_summary(written: DataFrame, text: str = "text", error: str = "error_code") -> DataFrame:
    """(outcome, error_code, pages, characters): what a session's report lists."""
    return written.groupBy("outcome", error).agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def write_documents(results: DataFrame, folder: str, url: str = "url", text: str = "text", error: str = "error_code") -> None:
    """The results' texts and metadata beside each other: ``texts`` by key, ``metadata`` as JSON lines with the same key."""
    keyed = results.where(F.col(error).isNull()).withColumn("key", F.sha2(F.col(url), 256))
    keyed.select("key", F.col(text).alias("text")).write.mode("overwrite").parquet(f"{folder}/texts")
    keyed.drop(text).write.mode("overwrite").json(f"{folder}/metadata")


class Subscriptions:
    """Deals the events of each batch to those who subscribed to their type, or to all.

    Use as ``events.writeStream.foreachBatch(subscriptions)``.  A batch is read once and kept while its
    subscribers run; a subscriber gets (events of its type, batch id), so that what it writes
    can be keyed by the batch.  An error of an awaited subscriber fails the batch, which is then run again;
    one of the others is counted.
    """

    def __init__(self, kind: str = "event_type"):
        self.kind, self.handlers, self.published, self.by_type, self.errors = kind, [], 0, Counter(), 0

    def subscribe(self, kind: str | None, handler: Handler, awaited: bool = True) -> Callable[[], None]:
        """Subscribe to one type, or to all with None; the result cancels it."""
        entry = (kind, handler, awaited)
        self.handlers.append(entry)
        return lambda: self.handlers.remove(entry) if entry in self.handlers else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            counts = {r[0]: r[1] for r in batch.groupBy(self.kind).agg(F.count(F.lit(1))).collect()}  # a row for each type
            for kind, handler, awaited in list(self.handlers):
                if kind is not None and kind not in counts or not counts:
                    continue
                try:
                    handler(batch if kind is None else batch.where(F.col(self.kind) == kind), batch_id)
                except Exception:
                    self.errors += 1
                    if awaited:
                        raise
            self.published += sum(counts.values())
            self.by_type.update(counts)
        finally:
            batch.unpersist()


def keyed_writer(folder: str) -> Handler:
    """A subscriber that writes its events to ``batch=N``, once however often the batch runs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return write
