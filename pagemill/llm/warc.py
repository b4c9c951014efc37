"""Operator 7: WARC archives by way of a chunked record table.

Writing: each payload becomes rows of (record, chunk number, bytes) of at most ``CHUNK``
bytes; the first row is a ``response`` record and further ones its ``continuation`` segments
(WARC-Segment-Number).  Of equal payloads of ``LEAST`` bytes or more, the one of the largest
id is kept and the others are ``revisit`` records that refer to it.  Spark's text writer puts
the rows into gzip files with the record separator.

Reading: gzip archives stream by as lines, whole files to a task and in order, and a small state
machine follows Content-Length.  It emits a row per chunk with its bytes, the running length and
the SHA-1 of the payload up to there, so the last chunk's row has the payload's own.  No whole
record of a written archive is held: a chunk is a record of its own there, and memory is one
Arrow batch of lines.  (An archive of others may have a payload without line ends; Spark's text
reader holds such a line whole.)  A record that breaks off, or whose length isn't a number, is a
last row with an ``error``; reading goes on at the next record.

Scale: a shuffle of digests to find equal payloads, and the join back; reading needs none but
the lookup of revisits.  Archives go to the folder given, or to the shared folder.

Cases: null html is an empty payload; a null url is left out; a null id never owns or refers
to a payload (response); repeated rows of the largest id are all responses; empty tables
give empty archives and results; payloads may hold any text, blank lines and WARC headers
too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import shared_dir, table

CHUNK = 32 << 10
LEAST = 1000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
FIELDS = (
    "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, "
    "chunk_no int, chunk_bytes long, payload_bytes long, payload_digest string, last boolean, error string, data binary"
)


def owners(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages`` (with __digest and __size) and ``__owner``: the id of the response they refer to, else null."""
    alike = (
        pages.where((F.col("__size") >= LEAST) & F.col(key).isNotNull())
        .groupBy("__digest", "__size")
        .agg(F.max(key).alias("__top"), F.min(key).alias("__low"))
        .where("__low != __top")
        .select("__digest", "__size", "__top")
    )
    joined = pages.join(alike, ["__digest", "__size"], "left")
    return joined.withColumn("__owner", F.when(F.col(key) != F.col("__top"), F.col("__top"))).drop("__top")


def record_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: record_id, chunk_no, chunks, head (record headers) and data."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    facts = pages.select(key, url, payload.alias("__payload"))
    facts = facts.select(key, url, "__payload", F.sha1("__payload").alias("__digest"), F.octet_length("__payload").cast("long").alias("__size"))
    known = owners(facts, key)
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), number(c), F.lit(">"))
    again = F.col("__owner").isNotNull()
    last = F.when(again, F.lit(0)).otherwise(F.greatest(F.ceil(F.col("__size") / chunk) - 1, F.lit(0))).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last), lambda c: F.when(again, F.lit(b"")).otherwise(F.substring("__payload", c * chunk + 1, F.lit(chunk)))
    )
    cut = known.select(
        urn(F.col(key)).alias("record_id"), F.regexp_replace(url, r"[\r\n]+", "").alias("uri"), "__digest", "__size",
        urn(F.col("__owner")).alias("owner"), again.alias("again"), (last + 1).alias("chunks"), F.posexplode(pieces).alias("chunk_no", "data"),
    )
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    first = F.col("chunk_no") == 0
    many = F.col("chunks") > 1
    http = F.when(first & ~F.col("again"), F.lit(HTTP)).otherwise("")
    part = F.concat(F.lit("<urn:page-segment:"), F.regexp_replace("record_id", "^<urn:page:|>$", ""), F.lit(":"), number(F.col("chunk_no") + 1), F.lit(">"))
    kind = F.when(~first, "continuation").when(F.col("again"), "revisit").otherwise("response")
    head = F.concat(
        F.lit("WARC/1.0"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(part)),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", F.col("uri"))).otherwise(""),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__digest"))).otherwise(""),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", F.col("owner")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", number(F.col("chunk_no") + 1))).otherwise(""),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("record_id"))).otherwise(""),
        F.when(many & (F.col("chunk_no") + 1 == F.col("chunks")), line("WARC-Segment-Total-Length", number(F.col("__size") + len(HTTP)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", number(F.length(http) + F.length("data"))),
        F.lit("\r\n\r\n"),
        http,
    )
    return cut.select("record_id", "chunk_no", "chunks", head.alias("head"), "data")


def write_warc(pages: DataFrame, path: str, **options) -> None:
    rows = record_rows(pages, **options)
    text = F.concat(F.encode("head", "UTF-8"), "data").cast("string")  # bytes stay as they are
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Follows the lines of one archive; ``rows`` gathers a tuple of FIELDS for each chunk."""

    def __init__(self, chunk: int, payload: bool):
        self.chunk, self.payload, self.rows = chunk, payload, []
        self.head: dict[str, str] | None = None
        self.left = 0  # bytes of the block still to come
        self.http = False
        self.record: dict[str, str] = {}
        self.sha, self.size, self.number, self.held, self.parts = hashlib.sha1(), 0, 0, 0, []
        self.open_end = False  # further segments of the record follow

    def line(self, line: bytes) -> None:
        if self.left:
            data = line + b"\n"
            took, self.left = data[: self.left], max(self.left - len(data), 0)
            self.block(took)
            if not self.left:
                self.close()
        elif self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
        elif line.startswith(b"WARC/") and self.head:  # the head before had no end
            self.fail("head without end")
            self.head = {}
        elif line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.strip().lower()] = value.strip()
        else:
            self.begin()

    def begin(self) -> None:
        head = self.head
        length, number = head.get("content-length", "0"), head.get("warc-segment-number", "1")
        if not (length.isascii() and length.isdigit() and number.isascii() and number.isdigit()):
            self.fail("length or segment number isn't a number")
            return
        self.left, number = int(length), int(number)
        if number == 1:
            if self.open_end:
                self.broken("segments missing")
            self.record, self.sha, self.size, self.number, self.held, self.parts = head, hashlib.sha1(), 0, 0, 0, []
            self.http = head.get("content-type", "").startswith("application/http") and self.left > 0
        self.open_end = "warc-segment-number" in head and "warc-segment-total-length" not in head
        if not self.left:
            self.close()

    def block(self, data: bytes) -> None:
        if self.http:  # the reply's own headers, up to a blank line
            self.http = data not in (b"\r\n", b"\n")
            return
        view = memoryview(data)
        while len(view):
            part = view[: self.chunk - self.held]
            view = view[len(part) :]
            self.sha.update(part)
            self.size += len(part)
            self.held += len(part)
            if self.payload:
                self.parts.append(bytes(part))
            if self.held == self.chunk and (len(view) or self.left or self.open_end):
                self.emit(False)

    def emit(self, last: bool, error: str | None = None) -> None:
        r = self.record
        digest = self.sha.hexdigest()
        stated = r.get("warc-payload-digest", "").removeprefix("sha1:") or None
        data = b"".join(self.parts) if self.payload else None
        self.rows.append(
            (r.get("warc-record-id"), r.get("warc-type"), r.get("warc-target-uri"), r.get("warc-refers-to"), stated, self.number, self.held, self.size, digest, last, error, data)
        )
        self.number, self.held, self.parts = self.number + 1, 0, []

    def broken(self, error: str) -> None:
        """The record so far ends here, with an error."""
        self.emit(True, error)
        self.open_end = False

    def fail(self, error: str) -> None:
        """A record of which nothing but the head is read."""
        if self.open_end:
            self.broken("segments missing")
        self.record, self.sha, self.size, self.number, self.held, self.parts = self.head, hashlib.sha1(), 0, 0, 0, []
        self.broken(error)
        self.head = None

    def close(self) -> None:
        if not self.open_end:
            self.emit(True)
        self.head = None

    def end(self) -> list[tuple]:
        """The rows left at the end of the archive."""
        if self.left:
            self.broken("archive ends inside the record")
        elif self.head:
            self.fail("archive ends inside the head")
        elif self.open_end:
            self.broken("segments missing")
        return self.rows


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """A row for each chunk of each record of the gzip archives under ``path``; see FIELDS.

    ``payload``: whether the rows carry the chunks' bytes.  Other files than ``*.gz`` are left out with a warning that
    names some: they could be split, and a part of an archive can't be read on its own.
    """
    names = spark.read.format("binaryFile").load(path).select("path")  # names only: contents aren't read
    if others := [r["path"] for r in names.where(~F.endswith(F.lower("path"), F.lit(".gz"))).limit(3).collect()]:
        warnings.warn(f"only .gz archives are read, these and others of their kind are left out: {', '.join(others)}", stacklevel=2)
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, _Reader(chunk, payload)
        for b in batches:
            done = []
            for line, of in zip(b.column(0), b.column(1).to_pylist()):
                if of != file:
                    done += reader.end()
                    file, reader = of, _Reader(chunk, payload)
                reader.line(line.as_py())
            done += reader.rows
            reader.rows = []
            yield batch(done)
        yield batch(reader.end())

    return lines.mapInArrow(run, FIELDS)


def resolved(chunks: DataFrame) -> DataFrame:
    """One row a record: (record_id, record_type, refers_to, payload_bytes, payload_digest, error); revisits get the payload they refer to."""
    records = chunks.where("last")
    given = (
        records.where("record_type = 'response' and error is null")
        .groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"))
        .agg(F.max("payload_bytes").alias("__bytes"))
    )
    joined = records.join(given, ["refers_to", "stated_digest"], "left")
    again = F.col("record_type") == "revisit"
    return joined.select(
        "record_id", "record_type", "refers_to",
        F.when(again, F.col("__bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "error",
    )


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    found = resolved(read_warc(spark, path, payload=False))
    return found.select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to")
    )


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> top THEN top END AS refers_to
FROM t
"""
