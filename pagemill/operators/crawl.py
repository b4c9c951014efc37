"""Crawling over a page table: frontier loops, robots rules and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import extract_links, normalize, should_crawl, sitemap_locs
from pagemill.sources.shared import written


def _linked(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(key, url, links) of each page once, of several with one key the first by URL; written: what the levels of a crawl join."""
    linked = pages.select(normalize(F.col(url)).alias("key"), F.col(url).alias("url"), extract_links(F.col(html), F.col(url)).alias("links"))
    return written(linked.groupBy("key").agg(F.min(F.struct("url", "links")).alias("p")).select("key", "p.url", "p.links"))


def crawl_order(
    pages: DataFrame, seeds: DataFrame, url: str = "url", html: str = "html", max_depth: int = 3, max_pages: int | None = None,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), robots: DataFrame | None = None, agent: str = "*",
) -> DataFrame:
    """Breadth-first crawl of each seed's site: (start, depth, place, key, url, parent).

    A level is one join of the frontier with the pages, and an anti join with what was seen;
    the driver only asks whether a level is empty.  ``place`` follows the order in which a queue
    would have met the pages: depth, place of the parent, position of the link.  ``max_pages``
    counts over the levels of a start; None takes all pages.
    """
    known = _linked(pages, url, html)
    order = Window.partitionBy("start").orderBy("up", "at")
    frontier = seeds.select(F.col(url).alias("start"), normalize(F.col(url)).alias("key"), F.lit(None).cast("string").alias("parent")).withColumns(
        {"up": F.lit(0).cast("long"), "at": F.lit(0)}
    )
    seen, levels, out = frontier.select("start", "key").distinct(), [], None
    for depth in range(max_depth + 1):
        level = frontier.join(known.drop("links"), "key").withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("depth", F.lit(depth))
        if max_pages is not None:
            taken = out.groupBy("start").agg(F.count(F.lit(1)).alias("taken")) if levels else seen.select("start", F.lit(0).alias("taken")).distinct()
            level = level.join(taken, "start").where(F.col("place") + F.col("taken") < max_pages)
        level = written(level.select("start", "depth", "place", "key", "url", "parent"))
        levels.append(level)
        out = level if out is None else out.union(level)
        if depth == max_depth or level.isEmpty():
            break
        links = level.join(known.select("key", "links"), "key").select("start", F.col("url").alias("parent"), F.col("place").alias("up"), F.posexplode("links").alias("at", "link"))
        links = links.where(should_crawl(F.col("link"), F.col("start"), include, exclude))
        if robots is not None:
            links = allowed(links, robots, "link", agent)
        first = Window.partitionBy("start", "key").orderBy("up", "at")
        fresh = links.withColumn("key", normalize(F.col("link"))).withColumn("rank", F.row_number().over(first)).where("rank = 1")
        frontier = written(fresh.join(seen, ["start", "key"], "left_anti").select("start", "key", "parent", "up", "at"))
        seen = seen.union(frontier.select("start", "key"))
    return out


def crawl(
    pages: DataFrame, seeds: DataFrame, url: str = "url", html: str = "html", max_depth: int = 3, max_pages: int | None = 100,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), robots: DataFrame | None = None, agent: str = "*",
) -> DataFrame:
    """``crawl_order`` with the pages: (start, depth, place, url, html, parent)."""
    order = crawl_order(pages, seeds, url, html, max_depth, max_pages, include, exclude, robots, agent)
    texts = pages.groupBy(F.col(url).alias("url")).agg(F.min(html).alias("html"))
    return order.join(texts, "url").select("start", "depth", "place", "url", "html", "parent")


def crawl_depth_first(pages: DataFrame, seeds: DataFrame, url: str = "url", html: str = "html", max_depth: int = 3, max_pages: int = 100) -> DataFrame:
    """Visit order of a depth-first crawl, a start to a task: (start, visit, depth, url).

    The order is sequential by nature; joins by level find the pages that a start can reach in
    ``max_depth`` steps, whose links are all that its walk holds.  It stops at ``max_pages``.
    """
    known = _linked(pages, url, html)
    known = written(known.select("key", "url", F.transform(F.filter("links", lambda x: should_crawl(x, F.col("url"))), normalize).alias("links")))
    starts = seeds.groupBy(F.col(url).alias("start")).agg(F.count(F.lit(1)).alias("copies")).withColumn("key", normalize(F.col("start")))
    reached = frontier = starts.select("start", "key")
    for _ in range(max_depth):
        fresh = frontier.join(known, "key").select("start", F.explode("links").alias("key")).distinct()
        frontier = written(fresh.join(reached, ["start", "key"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    first = starts.select("start", "copies", F.col("key").alias("first"))
    tables = reached.join(known, "key").join(first, "start")

    def walk(table):
        import pandas as pd

        rows = []
        by_key = {k: (u, list(x)) for k, u, x in zip(table["key"], table["url"], table["links"])}
        start, copies = table["start"].iloc[0], table["copies"].iloc[0]
        stack, seen, visit = [(table["first"].iloc[0], 0)], set(), 0
        while stack and visit < max_pages:
            key, depth = stack.pop()
            if key in seen or key not in by_key:
                continue
            seen.add(key)
            rows += [(start, visit, depth, by_key[key][0])] * copies
            visit += 1
            if depth < max_depth:
                stack += [(x, depth + 1) for x in reversed(by_key[key][1]) if x not in seen]
        return pd.DataFrame(rows, columns=["start", "visit", "depth", "url"])

    return tables.groupBy("start").applyInPandas(walk, "start string, visit long, depth int, url string")


def crawl_sitemap(sitemaps: DataFrame, pages: DataFrame, url: str = "url", xml: str = "xml", html: str = "html") -> DataFrame:
    """The pages that sitemaps list, in their order: (sitemap, place, url, html); html is null where the page isn't known."""
    listed = sitemaps.select(F.col(url).alias("sitemap"), F.posexplode(sitemap_locs(F.col(xml))).alias("place", "url"))
    known = pages.groupBy(normalize(F.col(url)).alias("key")).agg(F.min(F.struct(F.col(url), F.col(html).alias("html"))).alias("p")).select("key", "p.html")
    return listed.withColumn("key", normalize(F.col("url"))).join(known, "key", "left").select("sitemap", F.col("place").cast("long").alias("place"), "url", "html")


#: The crawls by name; one that needs a browser isn't here.
CRAWLS = {"BreadthFirst": crawl, "DepthFirst": crawl_depth_first, "Sitemap": crawl_sitemap}


def crawler(name: str):
    """The crawl of a name: its function, or an error that says what there is."""
    if name not in CRAWLS:
        raise ValueError(f"no crawl named {name}; there are {', '.join(CRAWLS)}")
    return CRAWLS[name]


def robots_rules(sites: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, agent, kind, path, place) rows of robots files; agents in a run share the rules that follow.

    kind: allow, disallow, crawl-delay or sitemap (agent null).  Agents are lower-cased; an
    empty disallow is no rule.
    """
    lines = sites.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("place", "line"))
    clean = F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"^\s+|\s+$", "")
    parts = lines.select(
        key, "place", F.lower(F.regexp_extract(clean, r"^([A-Za-z\-]+)\s*:", 1)).alias("kind"), F.regexp_extract(clean, r"^[A-Za-z\-]+\s*:\s*(.*)$", 1).alias("value")
    ).where("kind <> ''")
    rules = parts.where(F.col("kind").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy(key).orderBy("place")
    agent = F.col("kind") == "user-agent"
    starts = agent & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "user-agent")
    grouped = rules.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where(agent).select(key, "run", F.lower("value").alias("agent")).distinct()
    own = grouped.where(~agent & (F.col("value") != "")).select(key, "run", "kind", F.col("value").alias("path"), "place")
    sitemaps = parts.where("kind = 'sitemap'").select(key, F.lit(None).cast("string").alias("agent"), "kind", F.col("value").alias("path"), "place")
    return agents.join(own, [key, "run"]).select(key, "agent", "kind", "path", "place").union(sitemaps)


def crawl_delay(rules: DataFrame, key: str = "host", agent: str = "*") -> DataFrame:
    """(key, seconds): the last delay of 1 to 60 seconds for the agent or all agents."""
    own = rules.where((F.col("kind") == "crawl-delay") & F.col("agent").isin("*", agent.lower()))
    seconds = F.col("path").try_cast("int")
    return own.where(seconds.between(1, 60)).groupBy(key).agg(F.max_by(seconds, "place").alias("seconds"))


def allowed(links: DataFrame, rules: DataFrame, url: str, agent: str = "*") -> DataFrame:
    """Rows whose URL the rules allow: an allow prefix wins, else a disallow prefix forbids."""
    from pagemill.functions.urls import host, site_root

    own = rules.where(F.col("kind").isin("allow", "disallow"))
    mine = own.groupBy("host").agg(F.max((F.col("agent") == agent.lower()).cast("int")).alias("named"))
    chosen = own.join(mine, "host").where(F.col("agent") == F.when(F.col("named") == 1, agent.lower()).otherwise("*"))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    sides = chosen.groupBy(F.col("host").alias("__host")).agg(of("allow"), of("disallow"))
    path = F.substring(F.col(url), F.length(site_root(F.col(url))) + 1, F.length(url))
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, "#.*$", ""))
    hit = lambda kind: F.coalesce(F.exists(kind, lambda p: F.startswith(path, p)), F.lit(False))
    joined = links.join(sides, host(F.col(url)) == F.col("__host"), "left")
    return joined.where(hit("allow") | ~hit("disallow")).drop("__host", "allow", "disallow")


def retry_delay(given: Column, now: Column | None = None) -> Column:
    """Seconds of a Retry-After header: a number, or a date after ``now``; 60 if unreadable or past."""
    until = F.try_to_timestamp(F.regexp_replace(given, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    left = until.cast("double") - (F.current_timestamp() if now is None else now).cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(given.try_cast("double"), F.when(left > 0, left), F.lit(60.0)))


def retry_schedule(attempts: DataFrame, attempt: str = "attempt", retry_after: str | None = None, now: Column | None = None) -> Column:
    """Seconds to wait: Retry-After where given, else two to the attempt."""
    doubled = F.pow(F.lit(2.0), F.col(attempt))
    if retry_after is None:
        return doubled
    return F.when(F.col(retry_after).isNotNull(), retry_delay(F.col(retry_after), now)).otherwise(doubled)


def error_code(status: Column) -> Column:
    return F.when(status == 404, "NotFound").when(status.isin(401, 403, 429), "Blocked").when(status.between(500, 599), "ServerError").otherwise("Unknown")


#: Category, severity and whether to try again, by the kind of an exception; and those of any other.
ERRORS = {
    "HttpRequest": ("Network", "Error", True), "Timeout": ("Timeout", "Warning", True), "UnauthorizedAccess": ("Authentication", "Error", False), "Argument": ("Validation", "Warning", False),
    "InvalidOperation": ("Configuration", "Error", True), "NotSupported": ("NotSupported", "Error", True), "OutOfMemory": ("Resource", "Critical", False),
}
OTHER = ("General", "Error", True)


def error_facts(kind: Column) -> Column:
    """(category, severity, retryable, code) of an exception's name, with or without ``Exception`` at its end."""
    bare = F.regexp_replace(kind, "Exception", "")
    facts = lambda c, s, r: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(r).alias("retryable"))
    table = F.create_map(*[x for k, v in ERRORS.items() for x in (F.lit(k), facts(*v))])
    found = F.coalesce(F.try_element_at(table, bare), facts(*OTHER))
    return F.struct(found["category"].alias("category"), found["severity"].alias("severity"), found["retryable"].alias("retryable"), F.upper(bare).alias("code"))


def delays(policy: str, attempt: Column, base: float = 1.0, most: float = 60.0, jitter: float = 0.0, key: Column | None = None) -> Column:
    """Seconds before an attempt: fixed, linear or exponential, capped; jitter follows a hash of ``key``."""
    plain = {"fixed": F.lit(base), "linear": F.lit(base) * attempt, "exponential": F.lit(base) * F.pow(F.lit(2.0), attempt - 1)}[policy]
    spread = F.pmod(F.xxhash64(key, attempt), F.lit(1000)) / 1000.0 * jitter if key is not None and jitter else F.lit(0.0)
    return F.least(F.lit(most), plain * (1 + spread))
