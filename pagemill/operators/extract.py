"""Page extraction: cleaning, text density, Markdown, and chunks of the DOM; one parse a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions import text as T
from pagemill.functions.batches import by_slices, slices
from pagemill.functions.dom import Node

#: What the cleaner removes, and the density filter's weights.
ALWAYS = ("script", "style", "noscript", "iframe", "svg", "template", "link[rel='stylesheet']", "meta", "comment")
LAYOUT = (
    "header", "footer", "nav", "aside", "[role='navigation']", "[role='banner']", "[role='contentinfo']", "[role='complementary']",
    "[role='search']", ".gnb", ".lnb", ".snb", "#header_area", "#footer_area",
)
BOILERPLATE = (
    ".advertisement", ".ads", ".ad-container", ".ad-wrapper", ".adsbygoogle", "[id^='ad-']", "[class*='ad-slot']", ".sponsored", ".promotion",
    ".cookie-banner", ".cookie-consent", ".cookie-notice", "[id*='cookie']", "[class*='cookie-policy']", ".gdpr-banner", ".consent-banner",
    ".social-share", ".share-buttons", ".social-links", ".share-bar", ".sharing-buttons",
    ".related-posts", ".related-articles", ".recommended", ".you-might-like", ".more-stories",
    ".comments", ".comment-section", "#comments", "#disqus_thread",
    ".newsletter", ".subscribe", ".signup-form", ".email-signup", ".mailing-list",
    ".modal", ".popup", ".overlay", "[class*='popup']", "[class*='modal']",
    ".breadcrumb", ".breadcrumbs", ".pagination", ".sidebar", ".widget", ".menu", ".search-form", ".site-search", ".print-only", ".no-print",
    "[data-ad-slot]", "[data-ad-client]",
)
TAG_WEIGHTS = {
    "article": 2.0, "main": 2.0, "section": 1.5, "div": 1.0, "p": 1.5, "pre": 1.5, "code": 1.5, "blockquote": 1.3, "table": 1.2, "ul": 1.0,
    "ol": 1.0, "li": 1.0, "h1": 1.5, "h2": 1.5, "h3": 1.3, "h4": 1.2, "h5": 1.1, "h6": 1.1, "figure": 1.2, "figcaption": 1.2, "details": 1.1, "summary": 1.1,
}
NOISE_TAGS = ("nav", "footer", "header", "aside", "form")
GOOD_NAMES = ("content", "article", "body", "post", "text", "entry", "main", "story")
BAD_NAMES = ("comment", "sidebar", "widget", "menu", "nav", "footer", "header", "ad", "social", "share", "related", "promo", "banner")
MIN_TEXT, LINK_SHARE, TEXT_SHARE = 25, 0.5, 0.1
CONTAINERS = (
    "div", "section", "article", "aside", "nav", "header", "footer", "main", "form", "table", "ul", "ol", "dl", "figure", "details", "fieldset", "address",
)
CONTENT = ("article", "main", "[role='main']", ".content", "#content", ".post-content", ".entry-content", ".article-content")
EXCLUDED = (
    "nav", "footer", "header", "aside", ".sidebar", ".advertisement", ".ads", ".social-share", ".related-posts", ".comments", "#comments",
    ".navigation", ".menu", "[role='navigation']", "[role='complementary']", "[aria-hidden='true']",
)
SECTIONS = ("section", "div.section", "div[class*='section']")


def clean(root: Node, base: str, main_only: bool = True, keep: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> Node:
    """The body without scripts, layout and boilerplate; links made absolute."""
    unwanted = dom.select(root, ALWAYS + remove) + [
        n for n in dom.select(root, (LAYOUT if main_only else ()) + BOILERPLATE) if not any(dom.matches(n, s) for s in keep)
    ]
    for node in unwanted:
        node.remove()
    dom.absolute(root, base)
    return dom.first(root, "body") or root


class Measure(NamedTuple):
    """What an element holds: characters and white space at either end of its text, link text, markup, whether there are images."""

    size: int = 0
    lead: int = 0
    trail: int = 0
    links: int = 0
    markup: int = 0
    images: bool = False

    @property
    def trimmed(self) -> int:
        return max(self.size - self.lead - self.trail, 0)

    def then(self, other: Measure) -> Measure:
        return Measure(
            self.size + other.size,
            self.lead + other.lead if self.lead == self.size else self.lead,
            self.trail + other.trail if other.trail == other.size else other.trail,
            self.links + other.links, self.markup + other.markup, self.images or other.images,
        )


def _of_text(text: str) -> Measure:
    n = len(text)
    return Measure(n, n - len(text.lstrip()), n - len(text.rstrip()), 0, len(text))


def measures(root: Node) -> dict[int, Measure]:
    """The measure of every element by its identity: one pass from the leaves up."""
    found: dict[int, Measure] = {}
    for node in reversed(list(root.walk())):  # children come after their parents in document order
        inside = Measure()
        for child in node.children:
            if isinstance(child, str):
                inside = inside.then(_of_text(child))
                continue
            own = found[id(child)]
            tags = len(child.tag) + 2 + sum(len(k) + len(v) + 4 for k, v in child.attrs.items()) + (0 if child.tag in dom.VOID else len(child.tag) + 3)
            inside = inside.then(own._replace(
                links=own.links + (own.trimmed if child.tag == "a" else 0), markup=own.markup + tags, images=own.images or child.tag in ("img", "figure"),
            ))
        found[id(node)] = inside
    return found


def density(node: Node, m: Measure) -> float:
    """Content score of an element: positive for content, negative for boilerplate."""
    if not m.trimmed:
        return 0.0
    short = MIN_TEXT if node.tag not in ("ul", "ol") else max(MIN_TEXT // 3, 8)
    link_share, text_share = m.links / m.trimmed, m.trimmed / max(m.markup, 1)
    if m.images and m.trimmed < MIN_TEXT:
        return 0.5
    if link_share > LINK_SHARE and m.trimmed < short:
        return -1.0
    if link_share > 0.8:
        return -0.5
    if text_share < TEXT_SHARE and m.trimmed < short:
        return -0.3
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    held = lambda words: sum(bool(re.search(rf"(?:^|[ _-]){w}(?:[ _-]|$)", names)) for w in words)
    weight = 0.3 if node.tag in NOISE_TAGS else TAG_WEIGHTS.get(node.tag, 0.8)
    return text_share * weight + 0.2 * held(GOOD_NAMES) - 0.3 * held(BAD_NAMES)


def scored(root: Node) -> list[tuple[Node, float]]:
    """The containers of a tree in document order, each with its score."""
    found = measures(root)
    return [(n, density(n, found[id(n)])) for n in root.walk() if n.tag in CONTAINERS and n.parent]


def thinned(root: Node) -> int:
    """Drop the containers of negative score; all are scored before any goes.  Returns how many there were."""
    found = [node for node, score in reversed(scored(root)) if score < 0]
    for node in found:
        node.remove()
    return len(found)


def dense(root: Node) -> Node:
    """The tree without its containers of negative score."""
    thinned(root)
    return root


EXTRACTED = "title string, raw_markdown string, fit_markdown string"


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", main_only: bool = True) -> DataFrame:
    """``pages`` with title, Markdown before and after the density filter, text, headings, images and counts."""

    def one(page: str | None, address: str | None) -> tuple:
        try:
            return both(page, address)
        except (ValueError, RecursionError):  # an address or a nesting that can't be read: the plain text remains
            return None, None

    def both(page: str | None, address: str | None) -> tuple:
        root = dom.parse(page)
        body = clean(root, address, main_only)
        raw = dom.markdown(body)
        return raw, dom.markdown(body) if thinned(body) else raw

    def convert(htmls: pa.Array, urls: pa.Array) -> pa.Array:
        rows = [one(h, u) for h, u in zip(htmls.to_pylist(), urls.to_pylist())]
        return pa.array([{"raw": r, "fit": f} for r, f in rows], pa.struct([("raw", pa.string()), ("fit", pa.string())]))

    made = pages.withColumn("__md", by_slices(convert, "raw string, fit string", F.col(html), F.col(url)))
    plain = F.when(F.col("raw_markdown").isNull(), T.trim_all(T.decode_entities(T.strip_tags(F.coalesce(F.col(html), F.lit(""))))))
    text = F.coalesce(T.normalize_markdown(T.best_content(F.col("fit_markdown"), F.col("raw_markdown"), plain, F.lit(None))), F.lit(""))
    out = made.select("*", T.best_title(F.coalesce(F.col(html), F.lit(""))).alias("title"), F.col("__md.raw").alias("raw_markdown"), F.col("__md.fit").alias("fit_markdown")).drop("__md")
    out = out.withColumn("text", text)
    return out.withColumns(
        {
            "headings": T.markdown_headings(F.col("text")),
            "images": T.markdown_images(F.col("raw_markdown")),
            "description": T.description_of(F.col("text")),
            "word_count": T.word_count(F.col("text")),
            "char_count": F.length("text").cast("long"),
        }
    ).withColumn("reading_minutes", T.reading_minutes(F.col("word_count")))


def density_scores(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, tag, score) of every container."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, htmls in slices((batch.column(0), batch.column(1))):
                rows = [(k, i, n.tag, score) for k, h in zip(keys.to_pylist(), htmls.to_pylist()) for i, (n, score) in enumerate(scored(dom.parse(h)))]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.record_batch([pa.array(columns[0], keys.type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())], [key, "place", "tag", "score"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, place int, tag string, score double")


def faq(html: Column) -> Column:
    """(question, answer) of each block for questions: its first heading, and its first part marked as an answer."""

    def pairs(page: str | None) -> list[dict]:
        out = []
        for block in dom.select(dom.parse(page), ("div[class*='faq']", "div[class*='question']")):
            below = [n for n in block.walk() if n is not block]
            asked = next((n for n in below if n.tag in ("h3", "h4") or "question" in n.attrs.get("class", "")), None)
            said = next((n for n in below if any(w in n.attrs.get("class", "") for w in ("answer", "response"))), None)
            if asked and said and asked.text().strip() and said.text().strip():
                out.append({"question": asked.text().strip(), "answer": said.text().strip()})
        return out

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([pairs(h) for h in pages.to_pylist()], pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string())])))

    return by_slices(run, "array<struct<question:string,answer:string>>", html)


def dom_chunks(html: str | None, least: int = 100, most: int = 1500) -> list[dict]:
    """Chunks of a page by its structure: text, code, tables and lists, with the path of headings."""
    root = dom.parse(html)
    main = dom.first(root, *CONTENT) or dom.first(root, "body") or root
    for node in dom.select(main, EXCLUDED):
        node.remove()
    path: list[str] = []
    out: list[dict] = []

    def chunk(kind: str, content: str) -> dict:
        return {"chunk_type": kind, "content": content, "heading_path": list(path), "section_title": path[-1] if path else None}

    def leaf(node: Node) -> dict | None:
        if node.tag in ("pre", "code"):
            kind, content = "Code", node.text().strip()
        elif node.tag == "table":
            rows = [" | ".join(dom.flat(c.text()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")) for r in node.walk() if r.tag == "tr"]
            kind, content = "Table", "\n".join(r for r in rows if r)
        else:
            kind, content = "List", "\n".join(f"• {dom.flat(n.text())}" for n in node.walk() if n.tag == "li")
        return chunk(kind, content) if content else None

    def visit(node: Node, found: list[dict]) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    found.append(chunk("Text", child.strip()))
            elif re.fullmatch("h[1-6]", child.tag):
                del path[int(child.tag[1]) - 1 :]
                path.append(dom.flat(child.text()))
            elif child.tag in ("pre", "code", "table", "ul", "ol"):
                if made := leaf(child):
                    found.append(made)
            elif child.tag in ("script", "style"):
                continue
            elif any(dom.matches(child, s) for s in SECTIONS):
                inner: list[dict] = []
                visit(child, inner)
                found.extend(split_large(merge_small(inner, least), most))
            else:
                visit(child, found)

    visit(main, out)
    return out


def merge_small(chunks: list[dict], least: int) -> list[dict]:
    """A chunk under ``least`` characters joins the next one; the last joins the one before."""
    out, held = [], None
    for c in chunks:
        if held:
            c = c | {"content": held["content"] + "\n\n" + c["content"]}
            held = None
        if len(c["content"]) < least:
            held = c
        else:
            out.append(c)
    if held:
        if out:
            out[-1] = out[-1] | {"content": out[-1]["content"] + "\n\n" + held["content"]}
        else:
            out.append(held)
    return out


def split_large(chunks: list[dict], most: int) -> list[dict]:
    """Text over ``most`` characters is cut after sentences, as much as fits in each part."""
    out = []
    for c in chunks:
        if len(c["content"]) <= most or c["chunk_type"] != "Text":
            out.append(c)
            continue
        part = ""
        for sentence in re.split(r"(?<=\.)\s", c["content"]):
            if part and len(part) + 1 + len(sentence) > most:
                out.append(c | {"content": part})
                part = sentence
            else:
                part = f"{part} {sentence}" if part else sentence
        out.append(c | {"content": part})
    return out
