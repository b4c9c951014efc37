"""Readers and writers: whole files by kind, page tables, and results beside their failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.urls import normalize
from pagemill.operators.crawl import error_code, retry_delay


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, content_type) of whole text files."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("content"))
    suffix = F.lower(F.regexp_extract("url", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("html", "htm", "xhtml"), "text/html").when(suffix.isin("md", "markdown"), "text/markdown").when(suffix == "json", "application/json").when(suffix == "xml", "application/xml").otherwise("text/plain")
    return found.withColumn("content_type", kind)


def extractor_for(content_type: Column) -> Column:
    """The extractor of a content type by what it contains: Html, Json, Xml, Markdown, Text or Default."""
    kind = F.lower(T.trim_all(F.coalesce(content_type, F.lit(""))))
    has = lambda *words: kind.rlike("|".join(words))
    return F.when(has("html"), "Html").when(has("json"), "Json").when(has("xml"), "Xml").when(has("markdown", "md"), "Markdown").when(has("text/plain"), "Text").otherwise("Default")


def exact_extractor(content_type: Column) -> Column:
    """The extractor by the whole name, as the basic extractor chooses."""
    table = {"text/html": "Html", "application/xhtml+xml": "Html", "text/markdown": "Markdown", "application/json": "Json", "application/xml": "Xml", "text/xml": "Xml"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(content_type)), F.lit("Text"))


def basic_text(content: Column, content_type: Column) -> Column:
    """Plain text by content type: tags stripped from HTML, JSON written anew, others as they are."""
    kind = extractor_for(F.coalesce(content_type, F.lit("text/html")))
    html = T.trim_all(T.decode_entities(T.strip_tags(content)))
    json = F.coalesce(F.to_json(F.try_parse_json(content)), content)
    return F.when(kind == "Html", html).when(kind == "Json", json).otherwise(content)


def basic_title(content: Column, content_type: Column) -> Column:
    """The page's title, or the fixed one of its kind."""
    kind = extractor_for(F.coalesce(content_type, F.lit("text/html")))
    fixed = {"Json": "JSON Content", "Xml": "XML Content", "Markdown": "Markdown Content", "Text": "Text Content", "Default": "Text Content"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair]), kind), T.title_of(content))


#: Extractors of the caller's own, by name: column functions from content to text.
EXTRACTORS: dict = {}


def register_extractor(name: str, extract) -> None:
    """``extract(content)`` is used where ``extractor_for`` gives ``name``; a pandas or Arrow UDF will do."""
    EXTRACTORS[name] = extract


def extracted_text(content: Column, content_type: Column) -> Column:
    """``basic_text``, or the caller's extractor for the kind."""
    kind, chain = extractor_for(content_type), basic_text(content, content_type)
    for name, extract in EXTRACTORS.items():
        chain = F.when(kind == name, extract(content)).otherwise(chain)
    return chain


#: What a fetch has come to: its tries (outer) and requests of the try (inner), whether it ended, and the request that counts.
_FETCH = "struct<tries:int,requests:int,waited:double,ended:boolean,at:int,cancelled:boolean>"


def _fetch_step(max_retries: int, now: Column | None):
    """One request's reply folded into the state of its fetch."""

    def step(state: Column, reply: Column) -> Column:
        status, error = reply["status"], F.lower(F.coalesce(reply["error"], F.lit("network")))
        good, more = F.coalesce(status.between(200, 299), F.lit(False)), state["requests"] < max_retries
        cancelled = status.isNull() & (error == "cancelled")
        lost = status.isNull() & error.isin("network", "timeout")
        again = more & (F.coalesce(status == 429, F.lit(False)) | lost)
        wait = F.when(lost, F.pow(F.lit(2.0), state["requests"])).otherwise(retry_delay(F.coalesce(reply["retry_after"], F.lit("60")), now))
        over = ~again & (state["tries"] >= max_retries)
        ended = good | cancelled | over
        waited = F.when(good | cancelled, 0.0).when(again, wait).when(over, 0.0).otherwise(F.pow(F.lit(2.0), state["tries"]))
        new_try = ~ended & ~again
        made = F.struct(
            (state["tries"] + new_try.cast("int")).alias("tries"),
            F.when(new_try, 0).when(again & ~ended, state["requests"] + 1).otherwise(state["requests"]).alias("requests"),
            (state["waited"] + waited).alias("waited"),
            ended.alias("ended"),
            reply["attempt"].alias("at"),
            cancelled.alias("cancelled"),
        )
        return F.when(state["ended"], state).otherwise(made).cast(_FETCH)

    return step


def fetch_with_retries(urls: DataFrame, replies: DataFrame, url: str = "url", max_retries: int = 3, now: Column | None = None) -> DataFrame:
    """Each row of ``urls`` with the reply that ended its fetch: (url, attempts, waited, status, content_type, content, error_code).

    ``replies`` (url, attempt, status, content_type, content, and where there are any retry_after and error) holds
    what each request got, numbered from 0, from a log or a connector; a number that is left out is a request without
    a reply.  A fetch makes up to ``max_retries`` more tries after the first, 1, 2, 4, ... seconds apart, and ends with
    the first success.  Within a try a 429 is asked again after its Retry-After (60 seconds without one) and a lost
    or timed-out request after 1, 2, 4, ... seconds, ``max_retries`` times; other statuses and errors end the try.
    A cancelled request ends the fetch as ``Timeout``.  Of several replies to a request the best one by (success,
    status) counts; repeated URLs each get a row.

    The log is folded by URL over rows without contents, and joined once with the contents of the replies that count.
    """
    log = replies.select(
        "url", F.col("attempt").cast("int").alias("attempt"), F.col("status").cast("int").alias("status"), "content_type", "content",
        *[(F.col(c) if c in replies.columns else F.lit(None)).cast("string").alias(c) for c in ("retry_after", "error")],
    )
    most = (max_retries + 1) ** 2
    log = log.where(F.col("attempt").between(0, most - 1) & F.col("url").isNotNull())
    failed = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    request = log.groupBy("url", "attempt").agg(F.min(F.struct(failed.alias("failed"), "status", "retry_after", "error")).alias("r"))
    known = F.map_from_entries(F.collect_list(F.struct("attempt", "r")))  # (max_retries + 1)^2 entries at most
    facts = request.groupBy("url").agg(known.alias("known"), F.max("attempt").alias("last"))
    reply = lambda k: F.struct(*[F.try_element_at("known", k)[c].alias(c) for c in ("status", "retry_after", "error")], k.alias("attempt"))
    begun = F.struct(F.lit(0), F.lit(0), F.lit(0.0), F.lit(False), F.lit(-1), F.lit(False)).cast(_FETCH)
    folded = facts.select("url", F.aggregate(F.transform(F.sequence(F.lit(0), F.col("last")), reply), begun, _fetch_step(max_retries, now)).alias("s"))
    folded = folded.select("url", (F.col("s.at") + 1).alias("attempts"), F.col("s.waited").alias("waited"), "s.cancelled", F.col("s.at").alias("attempt"))
    body = log.groupBy("url", "attempt").agg(F.min(F.struct(failed.alias("failed"), "status", "content_type", "content")).alias("b"))
    got = folded.join(body, ["url", "attempt"], "left").select(F.col("url").alias("__url"), "attempts", "waited", "cancelled", "b.status", "b.content_type", "b.content")
    every = urls.select(F.col(url).alias("url")).join(got, F.col("url") == F.col("__url"), "left").drop("__url")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    code = F.when(ok & (T.trim_all(F.coalesce("content", F.lit(""))) == ""), "EmptyContent").when(ok, None).when(F.col("cancelled"), "Timeout")
    code = code.when(F.col("status").isNull(), "NetworkError").otherwise(error_code(F.col("status")))
    without = F.col("attempts").isNull()  # no reply at all: as many tries as are allowed
    return every.select(
        "url", F.when(without, max_retries + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(without, 2.0**max_retries - 1).otherwise(F.col("waited")).alias("waited"), "status", "content_type", "content", code.alias("error_code"),
    )


def extract_results(replies: DataFrame, output: str = "Markdown", max_length: int | None = None, images: bool = True, metadata: bool = True) -> DataFrame:
    """A row for each reply, failures too: (url, title, text, images, metadata, error_code); the row of a failure has no text.

    ``output``: Markdown as extracted, Html as it came, or PlainText without marks.
    """
    content, kind = F.coalesce("content", F.lit("")), F.col("content_type")
    text = {"Markdown": extracted_text(content, kind), "Html": content, "PlainText": T.trim_all(T.plain_text(extracted_text(content, kind)))}[output]
    text = F.left(text, F.lit(max_length)) if max_length is not None else text
    ok = F.col("error_code").isNull()
    pictures = F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?i)<img[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))
    return replies.select(
        "url", F.when(ok, basic_title(content, kind)).alias("title"), F.when(ok, text).alias("text"),
        F.when(ok & F.lit(images), pictures).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(ok & F.lit(metadata), F.struct(kind.alias("content_type"), F.length(content).alias("characters"))).alias("metadata"), "error_code",
    )


def fetch(urls: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Each wanted URL with its page, or an error row: a left join on the normalized URL; of several pages the first by URL."""
    stored = pages.groupBy(normalize(F.col("url")).alias("__key")).agg(F.min(F.struct("url", "html")).alias("p"))
    stored = stored.select("__key", "p.html", F.lit(200).alias("status"))
    joined = urls.withColumn("__key", normalize(F.col(url))).join(stored, "__key", "left").drop("__key")
    status = F.coalesce("status", F.lit(404))
    return joined.withColumn("status", status).withColumn("error_code", F.when(status != 200, error_code(status)))


def through_cache(wanted: DataFrame, cache: DataFrame, now: Column, key: str = "url") -> DataFrame:
    """``wanted`` with the cached ``content`` that hasn't expired, and ``from_cache``."""
    live = cache.where(F.col("expires_at") > now).select(key, F.col("content").alias("content")).dropDuplicates([key])
    return wanted.join(live, key, "left").withColumn("from_cache", F.col("content").isNotNull())


def split_results(results: DataFrame, error: str = "error_code") -> tuple[DataFrame, DataFrame]:
    return results.where(F.col(error).isNull()), results.where(F.col(error).isNotNull())
