"""Sources, cache, sinks and streams: failures as rows, pushed filters, exactly-once batches, state with timers."""

import datetime
import gzip
import json
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringEndsWith, StringStartsWith

from pagemill.sources import archive, pages
from pagemill.sources.cache import ContentCache
from pagemill.streaming import monitor, sinks


@pytest.fixture
def folder(tmp_path):
    """Page files of all kinds, tables, logs, and some that can't be read."""
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    (top / "a.html").write_text("<p>a</p>")
    (top / "sub" / "b.md").write_bytes(b"\xef\xbb\xbf# b")
    (top / "blank.txt").write_text(" \n")
    (top / "broken.xml").write_bytes(b"\xff\xfe\x00<")
    (top / "image.png").write_bytes(b"\x89PNG")
    (top / "_SUCCESS").write_text("")
    (top / ".hidden.html").write_text("no")
    rows = [{"url": f"u{k}", "attempt": k % 3, "status": 200 if k % 2 else 429, "content": "x" * k, "retry_after": 7} for k in range(40)]
    lines = [json.dumps(r) for r in rows] + ["", "{broken", "[1]", json.dumps({"url": None, "attempt": "nan"})]
    (top / "log.jsonl").write_text("\n".join(lines))
    (top / "more.jsonl.gz").write_bytes(gzip.compress(b'{"url": "z", "attempt": 0, "error": "network"}\n'))
    (top / "cut.jsonl.gz").write_bytes(gzip.compress(b'{"url": "y"}\n' * 500)[:-20])
    table = pa.table({"url": [f"p{k}" for k in range(30)], "html": [None if k == 3 else " " if k == 4 else f"<b>{k}</b>" for k in range(30)], "other": range(30)})
    pq.write_table(table, top / "table.parquet", row_group_size=7)
    pq.write_table(pa.table({"url": ["q"]}), top / "bare.parquet")
    (top / "not.parquet").write_bytes(b"PAR0" * 9)
    return str(top)


def test_archive_rows(spark, folder):
    rows = archive.archive(spark).option("partitionBytes", 300).load(folder).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert set(by_file) == {"a.html", "b.md", "blank.txt", "broken.xml", "image.png", "log.jsonl", "more.jsonl.gz", "cut.jsonl.gz", "table.parquet", "bare.parquet", "not.parquet"}
    one = {name: (found[0].status, found[0].content_type, found[0].content, found[0].error_code) for name, found in by_file.items() if len(found) == 1}
    assert one["a.html"] == (200, "text/html", "<p>a</p>", None) and one["b.md"] == (200, "text/markdown", "# b", None)
    assert {n: one[n][3] for n in ("blank.txt", "broken.xml", "image.png", "bare.parquet", "not.parquet")} == {
        "blank.txt": "EmptyContent", "broken.xml": "ParseError", "image.png": "UnsupportedContentType", "bare.parquet": "ParseError", "not.parquet": "ParseError",
    }
    log = by_file["log.jsonl"]
    assert sorted(r.url for r in log if r.error_code is None) == sorted(f"u{k}" for k in range(40)) and [r.error_code for r in log if r.error_code] == ["ParseError"] * 3
    assert all(r.retry_after == "7" for r in log if r.error_code is None)
    assert by_file["more.jsonl.gz"][0].error == "network" and by_file["cut.jsonl.gz"][-1].error_code == "ParseError"
    table = {r.url: (r.content, r.error_code) for r in by_file["table.parquet"]}
    assert len(table) == 30 and table["p3"] == (None, "EmptyContent") and table["p4"] == (" ", "EmptyContent") and table["p5"] == ("<b>5</b>", None)


def test_archive_filters(spark, folder):
    """Pushed filters give what Spark's own would, and leave files out."""
    every = archive.archive(spark).load(folder)
    known = every.collect()
    frame = spark.createDataFrame(known, every.schema)
    for rule in (
        "status = 200", "content_type = 'text/html'", "content_type is null", "url in ('u3', 'p7', 'nowhere')", "attempt > 0 and status = 429", "path like '%.jsonl'",
        "url like 'p1%' and content like '%1%'", "status is not null", "error_code is not null", "content_type <> 'text/html'", "url = 'q'",
    ):
        assert sorted(map(str, every.where(rule).collect())) == sorted(map(str, frame.where(rule).collect())), rule
    reader = archive.ArchiveReader({"path": folder}, every.schema)
    left = list(reader.pushFilters([EqualTo(("content_type",), "text/markdown"), Not(EqualTo(("status",), 1)), GreaterThan(("attempt",), -1), EqualTo(("content",), "x"), IsNull(("a", "b"))]))
    assert [type(f) for f in left] == [Not, EqualTo, IsNull]
    names = lambda reader: sorted(p.path.rsplit("/", 1)[1] for part in reader.partitions() for p in part.pieces)
    assert names(reader) == ["b.md", "cut.jsonl.gz", "log.jsonl", "more.jsonl.gz"]
    for rule, want in ((StringEndsWith(("path",), ".md"), ["b.md"]), (In(("content_type",), ("text/html",)), 7), (StringStartsWith(("url",), folder), 11)):
        reader = archive.ArchiveReader({"path": folder}, every.schema)
        assert not list(reader.pushFilters([rule]))
        assert names(reader) == want if isinstance(want, list) else len(names(reader)) == want, rule
    narrow = spark.read.format("page_archive").schema("url string, status int").load(folder)
    assert narrow.columns == ["url", "status"] and narrow.count() == len(known)
    cut = archive.ArchiveReader({"path": folder, "partitionBytes": "100"}, every.schema).partitions()
    assert len(cut) > 20 and all(len({p.path for p in part.pieces}) == 1 or sum(p.high - p.low for p in part.pieces) <= 100 for part in cut)
    with pytest.raises(Exception, match="No such file|NotFound|nowhere"):
        archive.archive(spark).load(folder + "/nowhere").count()


def test_archive_writer(spark, tmp_path):
    out = str(tmp_path / "replies")
    rows = [("u1", 0, 429, "7", None, "text/html", "é\n\"x\""), ("u1", 1, 200, None, None, "text/html", "<p>"), (None, 2, None, None, "timeout", None, None)]
    df = spark.createDataFrame(rows, archive.REPLY)
    back = lambda: sorted(map(str, archive.archive(spark).load(out).select(df.columns).collect()))
    df.repartition(2).write.format("page_archive").mode("append").save(out)
    assert back() == sorted(map(str, df.collect()))
    df.write.format("page_archive").mode("append").save(out)
    assert len(back()) == 6
    df.write.format("page_archive").mode("overwrite").save(out)
    assert back() == sorted(map(str, df.collect()))
    wrong = df.withColumn("content", F.udf(lambda _: 1 / 0, "string")("url"))
    with pytest.raises(Exception):
        wrong.write.format("page_archive").mode("append").save(out)
    assert back() == sorted(map(str, df.collect()))


def test_retries_end_by_status(spark):
    """429 waits for Retry-After, lost requests double, other statuses begin a new try, cancelling ends; repeated URLs stay."""
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    log = {
        "ok": [(0, 200, None, None)],
        "limited": [(0, 429, "5", None), (1, 429, None, None), (2, 429, "soon", None), (3, 200, None, None)],
        "date": [(0, 429, "Wed, 03 Jan 2024 00:00:30 GMT", None), (1, 200, None, None)],
        "lost": [(0, None, None, "timeout"), (1, None, None, "network"), (2, None, None, None), (3, 200, None, None)],
        "server": [(0, 500, None, None), (1, None, None, "network"), (2, 200, None, None)],
        "cancel": [(0, 503, None, None), (1, None, None, "Cancelled"), (2, 200, None, None)],
        "odd": [(k, None, None, "ssl") for k in range(5)],
        "short": [(0, 404, None, None)],
        "twice": [(0, 503, None, None), (0, 200, None, None)],
        "late": [(99, 200, None, None)],
    }
    rows = [(u, a, s, "text/html", "body" if s == 200 else None, r, e) for u, each in log.items() for a, s, r, e in each]
    replies = spark.createDataFrame(rows, "url string, attempt int, status int, content_type string, content string, retry_after string, error string")
    wanted = spark.createDataFrame([(u,) for u in (*log, "ok", "none", None)], "address string")
    found = pages.fetch_with_retries(wanted, replies, "address", 3, now).collect()
    assert sorted(map(str, (r.url for r in found))) == sorted(map(str, (*log, "ok", "none", None)))
    assert {r.url: (r.attempts, r.waited, r.status, r.error_code) for r in found} == {
        "ok": (1, 0.0, 200, None), "limited": (4, 125.0, 200, None), "date": (2, 30.0, 200, None), "lost": (4, 7.0, 200, None), "server": (3, 2.0, 200, None),
        "cancel": (2, 1.0, None, "Timeout"), "odd": (4, 7.0, None, "NetworkError"), "short": (1, 1.0, 404, "NotFound"), "twice": (1, 0.0, 200, None),
        "late": (4, 7.0, None, "NetworkError"), "none": (4, 7.0, None, "NetworkError"), None: (4, 7.0, None, "NetworkError"),
    }


def test_cache(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path / "cache"))
    at = lambda clock: F.lit(f"2024-01-01 {clock}").cast("timestamp")
    calls = []

    def compute(rows):
        calls.append(sorted(r.url for r in rows.collect()))
        return rows.select("url", F.when(F.col("url") != "bad", F.concat(F.lit(f"{len(calls)}:"), "url")).alias("content"))

    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("bad", 4), (None, 5)], "url string, n int")
    got = lambda **more: {(r.url, r.n): (r.content, r.from_cache) for r in cache.through(wanted, compute, **more).collect()}
    first = got(now=at("10:00:00"))
    assert first == {("a", 1): ("1:a", False), ("a", 3): ("1:a", False), ("b", 2): ("1:b", False), ("bad", 4): (None, False), (None, 5): (None, False)}
    assert calls == [["a", "b", "bad"]]
    assert got(now=at("10:59:59"))["b", 2] == ("1:b", True) and calls[1] == ["bad"]
    assert got(now=at("10:30:00"), kind="Html")["a", 1] == ("3:a", False)
    assert got(now=at("11:00:00"))["a", 3] == ("4:a", False)
    assert got(now=at("11:10:00"), force=True)["b", 2] == ("5:b", False)
    assert got(now=at("11:10:01"))["b", 2] == ("5:b", True)
    before = sorted(map(str, cache.live(at("11:10:00")).collect()))
    (tmp_path / "cache" / "delta-000000099-unfinished").mkdir()
    cache.compact(at("11:10:00"))
    assert sorted(map(str, cache.live(at("11:10:00")).collect())) == before
    assert cache.vacuum() > 1 and [v.base for v in cache.versions()] == [True] and sorted(map(str, cache.live(at("11:10:00")).collect())) == before
    assert got(now=at("11:20:00"))["a", 1] == ("5:a", True) and cache.rows().where("url = 'a' and format = 'Html'").count() == 1


RESULT = "url string, text string, error_code string"


def test_sink_writes_each_batch_once(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *names: spark.createDataFrame([(n, f"t{n}", None if n != "x" else "NotFound") for n in names], RESULT)
    sinks.write_batch(rows("a", "x"), 0, out)
    sinks.write_batch(rows("b"), 1, out)
    sinks.write_batch(rows("a", "x"), 0, out)  # run again
    found = sinks.read_sink(spark, out, RESULT)
    assert sorted((r.url, r.batch, r.outcome) for r in found.collect()) == [("a", 0, "result"), ("b", 1, "result"), ("x", 0, "failure")]
    assert sorted(map(tuple, sinks.session_summary(found).collect()), key=str) == [("failure", "NotFound", 1, 2), ("result", None, 2, 4)]
    sinks.write_documents(found, str(tmp_path / "docs"))
    texts, facts = spark.read.parquet(f"{tmp_path}/docs/texts"), spark.read.json(f"{tmp_path}/docs/metadata")
    assert sorted((r.url, r.text) for r in texts.join(facts, "key").collect()) == [("a", "ta"), ("b", "tb")]


def test_sink_survives_a_failed_batch(spark, tmp_path):
    """A batch that failed after it wrote is run again by the restarted stream, and counts once."""
    for k in range(3):
        spark.createDataFrame([(f"{k}-{i}", "t", None) for i in range(4)], RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    failures = [1]

    def write(batch, n):
        sinks.write_batch(batch, n, str(tmp_path / "out"))
        if n == 1 and failures:
            raise RuntimeError(f"lost {failures.pop()}")

    def run():
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    found = sinks.read_sink(spark, str(tmp_path / "out"), RESULT)
    assert sorted(r.url for r in found.collect()) == [f"{k}-{i}" for k in range(3) for i in range(4)] and found.select("batch").distinct().count() == 3


def test_subscriptions(spark, tmp_path):
    seen, deal = [], sinks.Subscriptions("kind")
    note = lambda name: lambda batch, n: seen.append((name, n, sorted(r.v for r in batch.collect())))

    def broken(batch, n):
        raise ValueError(n)

    cancel = deal.subscribe("a", note("a"))
    deal.subscribe(None, note("all"))
    deal.subscribe("b", note("b"))
    deal.subscribe("b", broken, awaited=False)
    batch = lambda rows: spark.createDataFrame(rows, "kind string, v int")
    deal(batch([("a", 1), ("b", 2), ("a", 3), ("c", 4)]), 0)
    cancel()
    deal(batch([("a", 5)]), 1)
    deal(batch([]), 2)
    assert seen == [("a", 0, [1, 3]), ("all", 0, [1, 2, 3, 4]), ("b", 0, [2]), ("all", 1, [5])]
    assert (deal.published, dict(deal.by_type), deal.errors) == (5, {"a": 3, "b": 1, "c": 1}, 1)
    deal.subscribe("c", broken)
    with pytest.raises(ValueError):
        deal(batch([("c", 6)]), 3)
    write = sinks.keyed_writer(str(tmp_path / "c"))
    for _ in range(2):
        write(batch([("c", 6)]), 3)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


JOBS = "job string, total long, error_code string, ts timestamp"


def test_job_monitor(spark, tmp_path):
    """State over batches and restarts; complete jobs are told once; a job without events is closed by its timer."""
    setting, store = monitor.STATE_STORE
    spark.conf.set(setting, store)
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    parts = [
        [("a", 3, None, at(1)), ("b", 9, "Timeout", at(2)), ("b", 9, "Timeout", at(2))],
        [("a", 3, "NotFound", at(3)), ("b", 9, "Blocked", at(4))],
        [("a", 3, None, at(5)), ("c", 1, None, at(6))],
        [("d", 2, None, at(400))],
        [("d", 2, None, at(401))],
        [("b", 2, None, at(402))],
    ]
    for part in parts:
        spark.createDataFrame(part, JOBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(JOBS).parquet(str(tmp_path / "in"))
        told = monitor.job_monitor(stream, ttl="1 hour", late="1 minute")
        told.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    of = lambda job: [(r.event, r.processed, r.failed, r.total, dict(r.errors)) for r in sorted((r for r in rows if r.job == job), key=lambda r: (r.updated, r.event != "progress"))]
    assert of("a") == [("progress", 1, 0, 3, {}), ("progress", 2, 1, 3, {"NotFound": 1}), ("completed", 3, 1, 3, {"NotFound": 1})]
    assert of("b") == [("progress", 2, 2, 9, {"Timeout": 2}), ("progress", 3, 3, 9, {"Timeout": 2, "Blocked": 1}), ("closed", 3, 3, 9, {"Timeout": 2, "Blocked": 1}), ("progress", 1, 0, 2, {})]
    assert of("c") == [("completed", 1, 0, 1, {})] and of("d") == [("progress", 1, 0, 2, {}), ("completed", 2, 0, 2, {})]


def test_observed_chunks_of_a_stream(spark, tmp_path):
    """The listener counts the rows that the plan made, not those that it read; other queries are passed over."""
    for k in range(4):
        spark.createDataFrame([(f"u{k}", "a b c")], "url string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = monitor.ChunkListener(lambda *x: told.append(x), every=5, query="chunks-test")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("url string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    words = monitor.observed(stream.select("url", F.explode(F.split("text", " ")).alias("w")), longest=F.max(F.length("w")))
    for name in ("chunks-test", "another"):
        words.writeStream.queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).format("noop").start().awaitTermination()
    for _ in range(100):
        if told and told[-1][0] == "completed":
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [(kind, n) for kind, n, _ in told] == [("started", 0), ("progress", 6), ("progress", 12), ("completed", 12)] and told[1][2]["longest"] == 1
