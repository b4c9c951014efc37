"""``page_archive``: a data source over folders of page files, page tables and reply logs, and a writer of reply logs.

    archive(spark).load(folder)                                    # or, registered before,
    spark.read.format("page_archive").load(folder)
    replies.write.format("page_archive").mode("append").save(folder)

One row for each page or reply, and one for each file or line that can't be read, with ``error_code``
instead of ``content``: a broken file doesn't end the job.

- ``.parquet``: a page table with the columns ``urlColumn`` (url) and ``contentColumn`` (html).
- ``.jsonl``, ``.ndjson``, also ``.gz``: a reply log, one JSON object a line; its fields are the schema's.
- ``.html``, ``.htm``, ``.xhtml``, ``.md``, ``.markdown``, ``.json``, ``.xml``, ``.txt``: a whole file is a page, its path its URL.
- any other file is one row with ``UnsupportedContentType``; names that begin with ``_`` or ``.`` are passed over.

Partitions: large tables and logs are cut by byte ranges (a row group or line belongs to the range
that it begins in; compressed logs aren't cut), small files are packed, both to about ``partitionBytes``.
Filters on ``url``, ``status``, ``attempt``, ``content_type`` and ``path`` are pushed down: files are left out by path
and kind, row groups by their statistics, and rows before they reach Spark.  A schema of the reader's own prunes columns.

A task holds one batch of rows (``batchBytes``, or one longer page); the driver the file names.
Paths are those that ``pyarrow.fs`` opens: local ones, ``file:``, ``hdfs:``, ``s3:``, ``gs:``.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrameReader, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

REPLY = "url string, attempt int, status int, retry_after string, error string, content_type string, content string"
SCHEMA = f"path string, {REPLY}, error_code string"
#: Content types by the suffix of a whole file.
KINDS = {
    ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".md": "text/markdown", ".markdown": "text/markdown",
    ".json": "application/json", ".xml": "application/xml", ".txt": "text/plain",
}
LOGS = (".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz")


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Piece(NamedTuple):
    """Bytes of a file; a whole file from 0 to its size."""

    path: str
    low: int
    high: int
    size: int

    @property
    def suffix(self) -> str:
        name = self.path.lower()
        return next((s for s in LOGS if name.endswith(s)), posixpath.splitext(name)[1])


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


_COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
_TEXTUAL = {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}


def as_expression(one: Filter, names: dict[str, str]) -> pc.Expression | None:
    """The filter over the columns that ``names`` gives for Spark's, or None where it has no form here."""
    column = getattr(one, "attribute", ())
    if len(column) != 1 or column[0] not in names:
        return None
    field = pc.field(names[column[0]])
    if type(one) in _COMPARED:
        return getattr(field, _COMPARED[type(one)])(pc.scalar(one.value))
    if type(one) in _TEXTUAL:
        return _TEXTUAL[type(one)](field, one.value)
    if isinstance(one, In):
        return field.isin(list(one.value))
    if isinstance(one, IsNull | IsNotNull):
        return field.is_null() if isinstance(one, IsNull) else field.is_valid()
    return None


PUSHED = ("path", "url", "attempt", "status", "content_type")


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("option path: the folder or file to read")
        self.url, self.content = options.get("urlColumn", "url"), options.get("contentColumn", "html")
        self.partition_bytes, self.batch_bytes = int(options.get("partitionBytes", 64 << 20)), int(options.get("batchBytes", 8 << 20))
        self.arrow = to_arrow_schema(schema)
        self.filters: list[Filter] = []

    # planning, on the driver

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if as_expression(one, {c: c for c in PUSHED}) is None or one.attribute[0] not in self.arrow.names:
                yield one
            else:
                self.filters.append(one)

    def _expression(self, names: dict[str, str]) -> pc.Expression | None:
        found = None
        for one in self.filters:
            if (part := as_expression(one, names)) is not None:
                found = part if found is None else found & part
        return found

    def _may_hold(self, piece: Piece) -> bool:
        """Whether a row of the file can pass the filters, by what is known without reading it."""
        failure = {"path": piece.path, "url": piece.path}
        page = {"path": piece.path, "status": 200, "attempt": 0, "content_type": KINDS.get(piece.suffix, "text/html")}
        if piece.suffix in LOGS:
            return self._passes({"path": piece.path})
        if piece.suffix in KINDS and self._passes(page | {"url": piece.path}) or piece.suffix == ".parquet" and self._passes(page):
            return True
        return self._passes(failure | dict.fromkeys(("status", "attempt", "content_type")))

    def _passes(self, known: dict) -> bool:
        rule = self._expression({c: c for c in known})
        return rule is None or pa.Table.from_pylist([known], _FULL).filter(rule).num_rows > 0

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.root)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        start, made, waiting, size = len(path.rstrip("/")), [], [], 0
        for file in sorted(files, key=lambda f: f.path):
            inner = file.path[start:].split("/") if found.type != fs.FileType.File else [file.base_name]
            if file.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in inner):
                continue
            piece = Piece(file.path, 0, file.size, file.size)
            if not self._may_hold(piece):
                continue
            if piece.suffix in (".parquet", ".jsonl", ".ndjson") and file.size > self.partition_bytes:
                edges = [*range(0, file.size, self.partition_bytes), file.size]
                made += [Pieces([piece._replace(low=a, high=b)]) for a, b in zip(edges, edges[1:])]
                continue
            if waiting and size + file.size > self.partition_bytes:
                made.append(Pieces(waiting))
                waiting, size = [], 0
            waiting.append(piece)
            size += file.size
        return made + [Pieces(waiting)] * bool(waiting) or [Pieces([])]

    # reading, in a task

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.root)
        rows, size = [], 0
        for piece in partition.pieces:
            for row in self._failures_as_rows(store, piece):
                if isinstance(row, pa.Table):
                    yield from self._shaped(row)
                    continue
                rows.append(row)
                size += len(row.get("content") or "") + 200
                if size >= self.batch_bytes:
                    yield from self._shaped(pa.Table.from_pylist(rows, _FULL))
                    rows, size = [], 0
        if rows:
            yield from self._shaped(pa.Table.from_pylist(rows, _FULL))

    def _shaped(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if (rule := self._expression({c: c for c in PUSHED})) is not None:
            rows = rows.filter(rule)
        yield from rows.select(self.arrow.names).cast(self.arrow).to_batches()

    def _failures_as_rows(self, store: fs.FileSystem, piece: Piece) -> Iterator[dict | pa.Table]:
        try:
            if piece.suffix == ".parquet":
                yield from self._table(store, piece)
            elif piece.suffix in LOGS:
                yield from self._log(store, piece)
            elif piece.suffix in KINDS:
                with store.open_input_file(piece.path) as file:
                    body = file.read().decode("utf-8-sig")
                row = {"path": piece.path, "url": piece.path, "attempt": 0, "status": 200, "content_type": KINDS[piece.suffix], "content": body}
                yield row | {"error_code": None if body.strip() else "EmptyContent"}
            else:
                yield _failure(piece, "UnsupportedContentType", f"no reader for {piece.suffix or 'files without a suffix'}")
        except (UnicodeDecodeError, gzip.BadGzipFile, EOFError, pa.ArrowInvalid, pa.ArrowKeyError) as wrong:
            yield _failure(piece, "ParseError", str(wrong))
        except OSError as wrong:
            yield _failure(piece, "NetworkError", str(wrong))

    def _table(self, store: fs.FileSystem, piece: Piece) -> Iterator[pa.Table]:
        kind = ds.ParquetFileFormat()
        whole = kind.make_fragment(piece.path, store)
        groups = [k for k, at in enumerate(_begins(whole)) if piece.low <= at < piece.high]
        if not groups:
            return
        for name in (self.url, self.content):
            if name not in whole.physical_schema.names:
                raise pa.ArrowInvalid(f"no column {name}")
        wanted = [c for c, of in (("url", self.url), ("content", self.content)) if c in self.arrow.names or c == "content" and "error_code" in self.arrow.names]
        columns = {c: ds.field({"url": self.url, "content": self.content}[c]) for c in wanted}
        part = kind.make_fragment(piece.path, store, row_groups=groups)
        for batch in part.to_batches(columns=columns, filter=self._expression({"url": self.url}), batch_size=1024):
            rows = pa.Table.from_batches([batch])
            n, text = rows.num_rows, pa.nulls(rows.num_rows, pa.string())
            made = {c: (rows.column(c).cast(pa.string()) if c in wanted else text) for c in ("url", "content")}
            blank = pc.fill_null(pc.equal(pc.utf8_trim_whitespace(made["content"]), ""), True)
            code = pc.if_else(blank, pa.scalar("EmptyContent"), pa.scalar(None, pa.string()))
            fixed = {"path": piece.path, "attempt": 0, "status": 200, "content_type": "text/html"}
            every = {f.name: pa.array([fixed[f.name]] * n, f.type) if f.name in fixed else made.get(f.name, code if f.name == "error_code" else text) for f in _FULL}
            yield pa.table(every, schema=_FULL)

    def _log(self, store: fs.FileSystem, piece: Piece) -> Iterator[dict]:
        with store.open_input_file(piece.path) as raw:
            file = gzip.GzipFile(fileobj=raw) if piece.suffix.endswith(".gz") else io.BufferedReader(raw)
            if piece.low:
                file.seek(piece.low - 1)
                file.readline()  # the line that begins before belongs to the range before
            while piece.suffix.endswith(".gz") or file.tell() < piece.high:
                line = file.readline()
                if not line:
                    return
                if line.strip():
                    yield _reply(piece, line)


def _begins(fragment: ds.ParquetFileFragment) -> Iterator[int]:
    """Where each row group begins in the file, by the compressed sizes of those before it."""
    at, facts = 0, fragment.metadata
    for group in range(facts.num_row_groups):
        yield at
        at += sum(facts.row_group(group).column(k).total_compressed_size for k in range(facts.num_columns))


def _failure(piece: Piece, code: str, error: str) -> dict:
    return {"path": piece.path, "url": piece.path, "error": error[:500], "error_code": code}


def _reply(piece: Piece, line: bytes) -> dict:
    try:
        row = json.loads(line)
        if not isinstance(row, dict):
            raise ValueError("not an object")
        text = {c: None if row.get(c) is None else str(row[c]) for c in ("url", "retry_after", "error", "content_type", "content")}
        number = {c: None if row.get(c) is None else int(row[c]) for c in ("attempt", "status")}
        return {"path": piece.path, **text, **number}
    except (ValueError, TypeError, OverflowError) as wrong:
        return _failure(piece, "ParseError", f"{wrong}: {line[:200]!r}")


_FULL = pa.schema(
    [(c, pa.int32() if c in ("attempt", "status") else pa.string()) for c in ("path", "url", "attempt", "status", "retry_after", "error", "content_type", "content", "error_code")]
)


class Wrote(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ReplyWriter(DataSourceArrowWriter):
    """Reply logs, a compressed file a task: written aside and moved by the commit, so that readers see nothing of a failed or repeated task."""

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite, self.job = options.get("path"), overwrite, uuid.uuid4().hex
        if not self.root:
            raise ValueError("option path: the folder to write")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        store, path = located(self.root)
        store.create_dir(f"{path}/_temporary-{self.job}", recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl.gz", 0
        with store.open_output_stream(f"{path}/_temporary-{self.job}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, compresslevel=4) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
                    rows += 1
        return Wrote([name] if rows else [])

    def commit(self, messages: list[Wrote | None]) -> None:
        store, path = located(self.root)
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")] if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{path}/_temporary-{self.job}/{name}", f"{path}/{name}")
        for name in old:
            store.delete_file(name)
        self.abort(messages)

    def abort(self, messages: list[Wrote | None]) -> None:
        store, path = located(self.root)
        if store.get_file_info(f"{path}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_temporary-{self.job}")


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ReplyWriter:
        return ReplyWriter(self.options, overwrite)


def archive(spark: SparkSession) -> DataFrameReader:
    """A reader of page archives; registers the source and lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchive)
    return spark.read.format("page_archive")
