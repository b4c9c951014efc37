"""A write-through cache of extracted contents: a versioned table in the shared folder, keyed by URL and format.

A ``put`` appends a delta folder; ``compact`` writes a new base of what is still live, so that readers who
listed the folder before keep their files.  The live table is the newest base without the keys that newer
deltas hold, and the newest row of each of those: the base is joined by its keys, never regrouped.

Rows: url, format, content, stored_at, expires_at.  Expired rows are misses and leave with the next ``compact``.
Readers take whole versions only (those with Spark's success mark).  Two writers at a time both add a delta;
of one key's rows the later ``stored_at`` counts, then the larger content.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["url", "format"]
SCHEMA = "url string, format string, content string, stored_at timestamp, expires_at timestamp"


class Version(NamedTuple):
    number: int
    base: bool
    path: str


class ContentCache:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # versions

    def versions(self) -> list[Version]:
        """All whole versions by number; what a job left unfinished has no success mark."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.folder)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        found = []
        for status in store.listStatus(root):
            name = re.fullmatch(r"(base|delta)-(\d+)-\w+", status.getPath().getName())
            if name and store.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
                found.append(Version(int(name[2]), name[1] == "base", status.getPath().toString()))
        return sorted(found)

    def _read(self, versions: list[Version]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[v.path for v in versions])

    def _current(self) -> tuple[list[Version], list[Version]]:
        every = self.versions()
        bases = [v for v in every if v.base][-1:]
        return bases, [v for v in every if not v.base and (not bases or v.number > bases[0].number)]

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.select("url", "format", "content", "stored_at", "expires_at").write.parquet(f"{self.folder}/{kind}-{number:09d}-{uuid.uuid4().hex[:12]}")

    # reading and writing

    def rows(self) -> DataFrame:
        """The newest row of each key, expired or not."""
        bases, deltas = self._current()
        newest = F.max_by(F.struct("content", "stored_at", "expires_at"), F.struct("stored_at", "content")).alias("r")
        newer = self._read(deltas).groupBy(*KEYS).agg(newest).select(*KEYS, "r.*")
        if not bases:
            return newer
        return self._read(bases).join(newer.select(*KEYS), KEYS, "left_anti").unionByName(newer)

    def live(self, now: Column) -> DataFrame:
        return self.rows().where(F.col("expires_at") > now)

    def put(self, contents: DataFrame, now: Column, minutes: float, kind: str) -> None:
        """Store (url, content) under format ``kind`` until ``minutes`` after ``now``."""
        numbers = [v.number for v in self.versions()]
        until = (now + F.make_dt_interval(mins=F.lit(0), secs=F.lit(60.0 * minutes))).alias("expires_at")
        rows = contents.where("url is not null").select("url", F.lit(kind).alias("format"), "content", now.alias("stored_at"), until)
        self._write(rows, "delta", max(numbers, default=0) + 1)

    def compact(self, now: Column) -> None:
        """One base of the live rows in place of the versions so far; these stay until ``vacuum``."""
        bases, deltas = self._current()
        if deltas:
            self._write(self.live(now), "base", deltas[-1].number)

    def vacuum(self) -> int:
        """Delete the versions that the newest base replaces; returns their number."""
        hadoop, (bases, _) = self.spark._jvm.org.apache.hadoop.fs, self._current()
        old = [v for v in self.versions() if bases and v.number <= bases[0].number and v != bases[0]]
        for version in old:
            path = hadoop.Path(version.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)

    def through(
        self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column, minutes: float = 60, kind: str = "Markdown", force: bool = False
    ) -> DataFrame:
        """``wanted`` (url, ...) with ``content`` and ``from_cache``: what is live is read, the rest computed once a URL and stored.

        ``compute`` gets the missing rows, one a URL, and gives (url, content); null contents aren't stored, so
        failures are tried again.  ``force`` computes all rows anew.  A null URL is computed for nothing: its content is null.
        """
        live = self.live(now).where(F.col("format") == kind).select("url", "content")
        if force:
            live = live.limit(0)
        missing = wanted.join(live.select("url"), "url", "left_anti").where("url is not null").dropDuplicates(["url"])
        before = self.versions()
        self.put(compute(missing).where("content is not null"), now, minutes, kind)
        added = [v for v in self.versions() if v not in before]
        fresh = self._read(added).where((F.col("format") == kind) & (F.col("stored_at") == now)).dropDuplicates(["url"])
        stored = live.join(fresh.select("url"), "url", "left_anti").withColumn("from_cache", F.lit(True)).unionByName(fresh.select("url", "content", F.lit(False).alias("from_cache")))
        return wanted.join(stored, "url", "left").withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))
