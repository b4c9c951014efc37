"""Structure of Markdown documents and site configuration files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.batches import by_slices


def front_matter(md: Column) -> Column:
    """``key: value`` pairs between the opening dashes, as a map; null where there are none."""
    block = F.regexp_extract(md, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s#][^:]*:"))
    entries = F.transform(lines, lambda x: F.struct(T.trim_all(F.regexp_extract(x, "^([^:]+):", 1)), F.regexp_replace(T.trim_all(F.regexp_extract(x, "^[^:]+:(.*)$", 1)), r"^[\"']|[\"']$", "")))
    kept = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_zip_with(m, F.map_from_arrays(F.array(e["col1"]), F.array(e["col2"])), lambda k, a, b: F.coalesce(b, a)))
    return F.when(block != "", kept)


def slug(heading: Column) -> Column:
    return F.translate(F.replace(F.lower(heading), F.lit(" "), F.lit("-")), "?!.,", "")


def headings(md: Column) -> Column:
    """(level, text, id) of each heading line outside code fences."""
    bare = F.regexp_replace(md, r"(?s)```.*?```", "")
    return F.transform(
        F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,6}[ \t]+.+$"), F.lit(0)),
        lambda x: F.named_struct(F.lit("level"), F.length(F.regexp_extract(x, "^(#+)", 1)), F.lit("text"), T.trim_all(F.regexp_replace(x, "^#+", "")), F.lit("id"), slug(T.trim_all(F.regexp_replace(x, "^#+", "")))),
    )


def toc(md: Column) -> Column:
    """A nested list of links to the headings."""
    return F.array_join(F.transform(headings(md), lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- ["), h["text"], F.lit("](#"), h["id"], F.lit(")"))), "\n")


def link_kind(url: Column) -> Column:
    """Internal, Email, AutoLink for a whole address, else Inline."""
    whole = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]+$")
    return F.when(F.startswith(url, F.lit("#")), "Internal").when(F.startswith(url, F.lit("mailto:")), "Email").when(whole, "AutoLink").otherwise("Inline")


#: What is embedded, by the hosts that an address names anywhere.
EMBEDS = {
    "YouTube": ("youtube.com", "youtu.be"), "Vimeo": ("vimeo.com",), "Twitter": ("twitter.com", "x.com"), "GitHubGist": ("gist.github.com",), "CodePen": ("codepen.io",),
}


def embed_kind(url: Column) -> Column:
    """The kind of what an address embeds; null for a plain link."""
    chain = F
    for kind, hosts in EMBEDS.items():
        held = F.contains(url, F.lit(hosts[0]))
        for host in hosts[1:]:
            held = held | F.contains(url, F.lit(host))
        chain = chain.when(held, kind)
    return chain.otherwise(None)


def embeds(elements: Column) -> Column:
    """(kind, url, title) of the links and images of a document that embed something."""
    found = F.filter(elements, lambda e: e["kind"].isin("Link", "Image") & embed_kind(e["target"]).isNotNull())
    return F.transform(found, lambda e: F.named_struct(F.lit("kind"), embed_kind(e["target"]), F.lit("url"), e["target"], F.lit("title"), e["text"]))


# Elements


ELEMENT = "array<struct<kind:string,text:string,target:string,level:int,items:int,done:int>>"
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([^\s`]*)")
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(\[[ xX]\][ \t]+)?\S")
_RULE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$")
_LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*([^)\s]*)[^)]*\)|<((?:https?://|mailto:)[^>\s]+)>")
_REFERENCE = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+.*)?$")
_BY_REFERENCE = re.compile(r"(!?)\[([^\]]+)\](?:\[([^\]]*)\])?(?![\[(:])")
_FRONT = re.compile(r"\A---\s*\n.*?\n---\s*\n", re.DOTALL)


def _scan(md: str) -> list[tuple[str, str, str | None, int, int, int]]:
    """(kind, text, target, level, items, done) of each element, in order; what stands in a quote follows it."""
    lines = _FRONT.sub("", md).split("\n")
    out = _blocks(lines, _references(lines))
    out += [["Math", m[1].strip(), None, 0, 0, 0] for m in re.finditer(r"(?s)\$\$(.+?)\$\$", md)]
    return [tuple(x) for x in out]


def _blocks(lines: list[str], addresses: dict[str, str], depth: int = 0) -> list[list]:
    """The elements of some lines: one pass, and one more over the lines of quotes, to a depth of 20."""
    out: list[list] = []
    fence, run = None, None  # the open fence; the kind of the block that the line before belongs to
    quoted: list[str] = []
    for k, line in enumerate([*lines, ""]):
        if not fence and line.startswith(">"):
            if run != "Quote":
                out.append(["Quote", line[1:].strip(), None, 0, 0, 0])
            quoted.append(re.sub(r"^> ?", "", line))
            run = "Quote"
            continue
        if quoted:
            out += _blocks(quoted, addresses, depth + 1) if depth < 20 else []
            quoted, run = [], None
        if k == len(lines):
            break
        mark = _FENCE.match(line)
        if fence:
            if mark and line.strip().startswith(fence[0]) and not mark[2]:
                out.append(["Code", "\n".join(fence[2]), fence[1] or None, 0, len(fence[2]), 0])
                fence = None
            else:
                fence[2].append(line)
            continue
        kind = None
        if mark:
            fence = (mark[1], mark[2], [])
        elif heading := re.match(r"^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*$", line):
            out.append(["Heading", heading[2], None, len(heading[1]), 0, 0])
        elif "|" in line and k + 1 < len(lines) and "|" in lines[k + 1] and _RULE.match(lines[k + 1]) and run != "Table":
            out.append(["Table", line.strip(), None, line.strip().strip("|").count("|") + 1, 0, 0])
            kind = "Table"
        elif run == "Table" and "|" in line:
            out[-1][4] += not _RULE.match(line)
            kind = "Table"
        elif item := _ITEM.match(line):
            if run != "List":
                out.append(["List", line.strip(), None, 0, 0, 0])
            out[-1][4] += 1
            out[-1][5] += bool(item[1]) and item[1][1] in "xX"
            kind = "List"
        elif _REFERENCE.match(line):
            run = None
            continue
        elif note := re.match(r"^\[\^([^\]]+)\]:\s*(.*)", line):
            out.append(["Footnote", note[2], note[1], 0, 0, 0])
        elif run == "List" and line.startswith(("  ", "\t")):
            kind = "List"
        block, run = len(out), kind
        found = _links(re.sub(r"`[^`]*`", "", line), addresses)
        if kind in ("Table", "List") and found:  # the block stays the last, for its next line
            out[block - 1 : block - 1] = found
        else:
            out += found
    if fence:
        out.append(["Code", "\n".join(fence[2]), fence[1] or None, 0, len(fence[2]), 0])
    return out


def _references(lines: list[str]) -> dict[str, str]:
    """The addresses that a document defines by name, outside code; of several for a name the first."""
    found: dict[str, str] = {}
    fenced = False
    for line in lines:
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _REFERENCE.match(line)):
            found.setdefault(" ".join(m[1].lower().split()), m[2])
    return found


def _links(line: str, addresses: dict[str, str]) -> list[list]:
    """Links and images of a line in order: with their address, between angle brackets, or by a name that the document defines."""
    found = [(m.start(), ["Image" if m[1] else "Link", m[2] or m[4] or "", m[3] if m[4] is None else m[4], 0, 0, 0]) for m in _LINK.finditer(line)]
    if addresses:
        for m in _BY_REFERENCE.finditer(line):
            target = addresses.get(" ".join((m[3] or m[2]).lower().split()))
            if target is not None:
                found.append((m.start(), ["Image" if m[1] else "Link", m[2], target, 0, 0, 0]))
    return [e for _, e in sorted(found, key=lambda f: f[0])]


def element_rows(md: Column) -> Column:
    """Every element of a document: headings, code, tables (rows as items, columns as level), lists, quotes, links, images, footnotes, math."""
    names = ("kind", "text", "target", "level", "items", "done")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("target", pa.string()), ("level", pa.int32()), ("items", pa.int32()), ("done", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, e)) for e in _scan(t or "")] for t in texts.to_pylist()], kind)

    return by_slices(run, ELEMENT, md)


def _of(elements: Column, kind: str) -> Column:
    return F.filter(elements, lambda e: e["kind"] == kind)


def _valid_share(found: Column, valid) -> Column:
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(F.filter(found, valid)) / F.size(found))


def accuracy(elements: Column) -> Column:
    """How well formed the elements are: headings .3, links .2, code .15, tables .15, lists .1, images .1."""
    heads = F.transform(_of(elements, "Heading"), lambda e: e["level"])
    skips = F.size(F.filter(F.zip_with(heads, F.slice(heads, F.lit(2), F.size(heads)), lambda a, b: F.coalesce(b - a > 1, F.lit(False))), lambda x: x))
    order = F.greatest(F.lit(0.0), 1.0 - F.when(F.get(heads, F.lit(0)) != 1, 0.2).otherwise(0.0) - skips * 0.1)
    address = lambda e: (F.coalesce(e["target"], F.lit("")) != "") & ~F.coalesce(e["target"], F.lit("")).rlike(r"[\s<>\"{}|\\^`]")
    both = F.concat(_of(elements, "Link"), _of(elements, "Image"))
    return (
        F.when(F.size(heads) == 0, 0.0).otherwise(order) * 0.30
        + _valid_share(both, address) * 0.20
        + _valid_share(_of(elements, "Code"), lambda e: e["text"] != "") * 0.15
        + _valid_share(_of(elements, "Table"), lambda e: (e["text"] != "") & (e["items"] > 0)) * 0.15
        + _valid_share(_of(elements, "List"), lambda e: e["items"] > 0) * 0.10
        + _valid_share(_of(elements, "Image"), lambda e: (F.coalesce(e["target"], F.lit("")) != "") & (e["text"] != "")) * 0.10
    )


def complexity(elements: Column) -> Column:
    weights = {"Heading": 0.1, "Code": 0.2, "Table": 0.3, "List": 0.1, "Link": 0.05, "Image": 0.05}
    return F.least(F.lit(1.0), sum((F.size(_of(elements, k)) * w for k, w in weights.items()), F.lit(0.0)) / 10.0)


def readability(words: Column, characters: Column, paragraphs: Column) -> Column:
    score = 206.835 - 1.015 * (words / F.nullif(paragraphs, F.lit(0))) - 84.6 * (characters / F.nullif(words, F.lit(0)))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100.0)), F.lit(0.0))


def quality(elements: Column, words: Column, readable: Column, title: Column, description: Column) -> dict[str, Column]:
    """Part scores of a document, their weighted whole, and the issues behind them."""
    heads, images = _of(elements, "Heading"), _of(elements, "Image")
    bare = F.size(F.filter(images, lambda e: e["text"] == ""))
    first = F.coalesce(F.get(heads, F.lit(0))["level"] != 1, F.lit(False))
    less = lambda when, by: F.when(when, by).otherwise(0.0)
    parts = {
        "structural": 1.0 - less(F.size(heads) == 0, 0.3),
        "content": 1.0 - less(words < 100, 0.2) - 0.1 * bare / F.greatest(F.size(images), F.lit(1)),
        "readability": readable,
        "accessibility": F.greatest(F.lit(0.0), F.when(F.size(images) > 0, 1.0 - bare / F.size(images)).otherwise(1.0) - less(first, 0.2)),
        "seo": 1.0 - less(F.coalesce(title, F.lit("")) == "", 0.3) - less(F.coalesce(description, F.lit("")) == "", 0.2),
    }
    weights = {"structural": 0.3, "content": 0.25, "readability": 0.2, "accessibility": 0.15, "seo": 0.1}
    issues = F.array_compact(
        F.array(
            F.when(F.size(heads) == 0, "Warning: no headings"), F.when(words < 100, "Info: short"), F.when(bare > 0, "Warning: images without alt text"),
            F.when(first, "Warning: first heading is not h1"), F.when(F.coalesce(title, F.lit("")) == "", "Warning: no title"),
        )
    )
    advice = F.array_compact(
        F.array(
            F.when(F.size(heads) == 0, "add headings"), F.when(words < 100, "write more"), F.when(bare > 0, "describe all images"), F.when(first, "begin with a heading of the first level"),
            F.when(F.coalesce(title, F.lit("")) == "", "give the document a title"), F.when(F.coalesce(description, F.lit("")) == "", "add a description"),
        )
    )
    strengths = F.array_compact(F.array(F.when(F.size(heads) > 0, "clear headings"), F.when(F.size(heads) > 3, "detailed table of contents")))
    return {**parts, "overall": sum((parts[k] * w for k, w in weights.items()), F.lit(0.0)), "issues": issues, "recommendations": advice, "strengths": strengths}


def to_html(md: Column) -> Column:
    """Headings, paragraphs, lists, quotes, code, tables, links, images and emphasis as HTML."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _html(t) for t in texts.to_pylist()], pa.string())

    return by_slices(run, "string", md)


def _inline(text: str) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for pattern, by in (
        (r"`([^`]+)`", r"<code>\1</code>"), (r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1" />'), (r"\[([^\]]*)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>'),
        (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"),
    ):
        text = re.sub(pattern, by, text)
    return text


def _html(md: str) -> str:
    out: list[str] = []
    body, code = _FRONT.sub("", md), []
    body = re.sub(r"(?ms)^```([^\n]*)\n(.*?)^```[ \t]*$", lambda m: code.append((m[1].strip(), m[2])) or f"\n\n\0{len(code) - 1}\0\n\n", body)
    for block in filter(None, (b.strip("\n") for b in re.split(r"\n\s*\n", body))):
        lines = block.split("\n")
        if held := re.fullmatch("\0(\\d+)\0", block.strip()):
            kind, text = code[int(held[1])]
            plain = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            out.append(f'<pre><code class="language-{kind}">{plain}</code></pre>' if kind else f"<pre><code>{plain}</code></pre>")
        elif heading := re.match(r"^(#{1,6})[ \t]+(.+)", lines[0]):
            out.append(f"<h{len(heading[1])}>{_inline(heading[2].strip())}</h{len(heading[1])}>")
            if rest := "\n".join(lines[1:]).strip():
                out.append(_html(rest))
        elif len(lines) > 1 and "|" in lines[0] and _RULE.match(lines[1]):
            cells = lambda line, tag: "<tr>" + "".join(f"<{tag}>{_inline(c.strip())}</{tag}>" for c in line.strip().strip("|").split("|")) + "</tr>"
            out.append("<table>" + cells(lines[0], "th") + "".join(cells(x, "td") for x in lines[2:]) + "</table>")
        elif all(_ITEM.match(x) for x in lines):
            tag = "ol" if re.match(r"\s*\d", lines[0]) else "ul"
            items = (_inline(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x)) for x in lines)
            out.append(f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>")
        elif lines[0].startswith(">"):
            out.append("<blockquote><p>" + _inline("\n".join(re.sub(r"^>\s?", "", x) for x in lines)) + "</p></blockquote>")
        else:
            out.append("<p>" + _inline(block) + "</p>")
    return "\n".join(out)


def elements(md: Column) -> dict[str, Column]:
    """Counts of each kind of element."""
    count = lambda p: F.coalesce(F.regexp_count(md, F.lit(p)), F.lit(0)).cast("long")
    return {
        "headings": F.size(headings(md)).cast("long"), "code_blocks": count(r"(?ms)^```.*?^```"), "links": count(r"(?<!!)\[[^\]]*\]\([^)]+\)"), "images": count(r"!\[[^\]]*\]\([^)]+\)"),
        "tables": count(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"), "list_items": count(r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+\S"),
        "tasks": count(r"(?m)^[ \t]*[-*+][ \t]+\[[ xX]\]"), "quotes": count(r"(?m)^>"), "footnotes": count(r"(?m)^\[\^[^\]]+\]:"), "math": count(r"(?s)\$\$.+?\$\$"),
    }


def text_statistics(md: Column) -> dict[str, Column]:
    words = F.regexp_count(md, F.lit(r"(?U)\b\w+\b")).cast("long")
    return {
        "lines": F.size(F.split(md, "\n")).cast("long"), "words": words, "characters": F.length(md).cast("long"),
        "visible_characters": F.length(F.regexp_replace(md, r"(?U)\s", "")).cast("long"),
        "paragraphs": F.size(F.filter(F.split(md, r"\n\s*\n"), lambda p: T.trim_all(p) != "")).cast("long"), "reading_minutes": F.ceil(words / 250.0).cast("long"),
    }


#: File names and content marks of site generators.
SITE_FILES = {
    "_config.yml": "Jekyll", "_config.yaml": "Jekyll", "config.toml": "Hugo", "hugo.toml": "Hugo", "hugo.yaml": "Hugo", "hugo.yml": "Hugo",
    "book.json": "GitBook", "gatsby-config.js": "Gatsby", "mkdocs.yml": "MkDocs", "docusaurus.config.js": "Docusaurus", "_quarto.yml": "Quarto",
}


def site_kind(name: Column, yaml: Column) -> Column:
    chain = F
    for file, kind in SITE_FILES.items():
        chain = chain.when(F.endswith(F.lower(name), F.lit(file)), kind)
    return (
        chain.when(yaml.rlike(r"(?m)^(?:jekyll|plugins|gems|permalink|collections)\s*:"), "Jekyll").when(yaml.rlike(r"(?mi)^(?:baseURL|languageCode|contentDir)\s*:"), "Hugo")
        .when(yaml.rlike(r"(?m)^(?:gitbook|structure)\s*:"), "GitBook").otherwise("Generic")
    )


_KEY = re.compile(r"^(\s*)(-\s+)?([^\s#:'\"][^:#]*|'[^']+'|\"[^\"]+\"):(?:\s+(.*))?$")


def _yaml_paths(text: str) -> dict[str, str]:
    """Path and text of every scalar of block-style YAML, and of flow lists: ``a.b[0].c``; what can't be read is left out."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []  # (indent, path) of the open maps and lists
    counts: dict[str, int] = {}

    def put(path: str, value: str) -> None:
        value = re.sub(r"(?:^|\s)#.*$", "", value).strip() if value[:1] not in "'\"" else value.strip()
        if value.startswith("[") and value.endswith("]"):
            for k, part in enumerate(filter(None, (x.strip() for x in value[1:-1].split(",")))):
                out[f"{path}[{k}]"] = part.strip("'\"")
        elif value not in ("", "null", "~"):
            out[path] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value

    for line in text.split("\n"):
        line = line.rstrip().expandtabs(2)
        if not line.strip() or line.lstrip().startswith(("#", "---")):
            continue
        indent, item = len(line) - len(line.lstrip()), line.lstrip().startswith("- ")
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (item and stack[-1][1].endswith("\0"))):
            stack.pop()
        parent = stack[-1][1].rstrip("\0") if stack else ""
        if item:
            number = counts.get(parent, 0)
            counts[parent] = number + 1
            parent, line = f"{parent}[{number}]", " " * (indent + 2) + line.lstrip()[2:].lstrip()
            stack.append((indent + 1, parent))
            indent += 2
        if found := _KEY.match(line):
            name = found[3].strip().strip("'\"")
            path = f"{parent}.{name}" if parent else name
            if found[4]:
                put(path, found[4])
            else:
                stack.append((indent, path + "\0"))
        elif item:
            put(parent, line.strip())
    return out


def yaml_paths(yaml: Column) -> Column:
    """Nested settings as a map from path to text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(_yaml_paths(t or "").items()) for t in texts.to_pylist()], pa.map_(pa.string(), pa.string()))

    return by_slices(run, "map<string,string>", yaml)


#: Plugins that are out of use.
DEPRECATED = ("jekyll-paginate", "redcarpet")


def site_config(name: Column, yaml: Column, paths: Column) -> dict[str, Column]:
    """Typed sections of a site's settings; ``paths`` is ``yaml_paths`` of the file."""
    get = lambda *keys: F.coalesce(*[T.none_if_blank(F.try_element_at(paths, F.lit(k))) for k in keys])
    flag = lambda *keys: F.coalesce(F.lower(get(*keys)).isin("true", "yes", "on", "1"), F.lit(False))
    under = lambda *roots: F.size(F.filter(F.map_keys(paths), lambda k: k.rlike(rf"^(?:{'|'.join(roots)})[.\[]"))) > 0
    many = lambda *roots: F.transform(
        F.array_sort(F.filter(F.map_entries(paths), lambda e: e["key"].rlike(rf"^(?:{'|'.join(roots)})\[\d+\]$")), lambda a, b: F.length(a["key"]) * 1000 - F.length(b["key"]) * 1000 + F.when(a["key"] < b["key"], -1).otherwise(1)), lambda e: e["value"]
    )
    plugins = many("plugins", "gems")
    return {
        "kind": site_kind(name, yaml), "title": get("title", "name"), "description": get("description"), "url": get("url", "baseURL", "baseurl"), "language": get("lang", "language", "languageCode"),
        "author": get("author.name", "author"), "author_email": get("author.email", "email"), "permalink": get("permalink"), "environment": get("environment"), "show_drafts": flag("show_drafts"),
        "target": get("deployment.target", "deploy.target", "target"), "plugins": plugins, "collections": F.array_sort(F.array_distinct(F.filter(F.transform(F.map_keys(paths), lambda k: F.regexp_extract(k, r"^collections\.([^.\[]+)", 1)), lambda k: k != ""))),
        "analytics": get("google_analytics"), "sitemap": flag("sitemap", "generate_sitemap") | F.array_contains(plugins, "jekyll-sitemap"), "social": under("social", "social_media", "twitter"),
        "compress_html": flag("compress_html", "compress_html.enabled") | under("compress_html"), "sass_style": get("sass.style"), "cache": under("cache"), "cdn": under("cdn") | get("cdn").isNotNull(),
    }


def site_issues(c: dict[str, Column]) -> Column:
    """(severity, key) of each fault in the settings."""
    issue = lambda when, severity, key: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(key).alias("key")))
    found = F.array_compact(
        F.array(
            issue(c["title"].isNull(), "Error", "title"), issue(c["description"].isNull(), "Warning", "description"),
            issue((c["environment"] == "development") & c["target"].isNotNull(), "Critical", "environment"), issue(c["show_drafts"] & (c["environment"] == "production"), "Warning", "show_drafts"),
            issue(~c["compress_html"], "Info", "compress_html"), issue(F.coalesce(c["sass_style"] != "compressed", F.lit(True)), "Info", "sass.style"),
            issue(c["analytics"].isNull(), "Info", "google_analytics"), issue(~c["sitemap"], "Warning", "sitemap"),
        )
    )
    old = F.transform(F.filter(c["plugins"], lambda p: F.lower(p).isin(*DEPRECATED)), lambda p: F.struct(F.lit("Warning").alias("severity"), F.concat(F.lit("plugins: "), p).alias("key")))
    return F.concat(found, old)


#: What takes the place of each plugin that is out of use.
IN_PLACE_OF = {"jekyll-paginate": "jekyll-paginate-v2", "redcarpet": "kramdown"}


def site_recommendations(c: dict[str, Column]) -> Column:
    """(type, priority, setting, current, recommended) of each change that would improve the settings."""
    names = ("type", "priority", "setting", "current", "recommended")

    def advice(when: Column, *values: str | Column | None) -> Column:
        columns = [v if isinstance(v, Column) else F.lit(v).cast("string") for v in values]
        return F.when(when, F.named_struct(*[x for n, v in zip(names, columns) for x in (F.lit(n), v)]))

    found = F.array(
        advice(~c["compress_html"], "Performance", "Medium", "compress_html", "false", "true"),
        advice(F.coalesce(c["sass_style"] != "compressed", F.lit(True)), "Performance", "Medium", "sass.style", F.coalesce(c["sass_style"], F.lit("expanded")), "compressed"),
        advice(F.coalesce(c["show_drafts"] & (c["environment"] == "production"), F.lit(False)), "Security", "High", "show_drafts", "true", "false"),
        advice(c["analytics"].isNull(), "Seo", "Medium", "google_analytics", None, "GA_TRACKING_ID"),
        advice(~c["sitemap"], "Seo", "High", "sitemap", "false", "true"),
    )
    better = F.create_map(*[F.lit(x) for pair in IN_PLACE_OF.items() for x in pair])
    old = F.transform(
        F.filter(c["plugins"], lambda p: F.lower(p).isin(*DEPRECATED)),
        lambda p: F.named_struct(*[x for n, v in zip(names, (F.lit("BestPractice"), F.lit("Medium"), F.lit("plugins"), p, F.try_element_at(better, F.lower(p)))) for x in (F.lit(n), v)]),
    )
    return F.concat(F.array_compact(found), old)


#: Which generator's settings can be written for which other one.
MIGRATIONS = {"Jekyll": ("Hugo", "GitBook"), "Hugo": ("Jekyll", "GitBook"), "GitBook": ("Jekyll", "Hugo")}


def can_migrate(source: Column, target: str) -> Column:
    """Whether settings of one generator have a form for another; to itself always."""
    return (source == target) | source.isin(*[s for s, targets in MIGRATIONS.items() if target in targets])


def site_quality(c: dict[str, Column]) -> dict[str, Column]:
    """Completeness, security, performance, SEO and practice of the settings, each from 0 to 1, and their mean."""
    total = lambda **parts: sum((F.when(F.coalesce(when, F.lit(False)), float(n)).otherwise(0.0) for when, n in parts.values()), F.lit(0.0))
    has = lambda name: c[name].isNotNull()
    parts = {
        "completeness": total(
            a=(has("title"), 2), b=(has("description"), 2), c=(has("url"), 1), d=(has("author"), 1), e=(has("permalink"), 1), f=(F.size(c["plugins"]) > 0, 1), g=(has("analytics"), 1), h=(c["sitemap"], 1)
        ) / 10.0,
        "security": 1.0 - total(a=((c["environment"] == "development") & has("target"), 0.3), b=(c["show_drafts"] & (c["environment"] == "production"), 0.2)),
        "performance": total(a=(c["compress_html"], 1), b=(c["sass_style"] == "compressed", 1), c=(c["cache"], 1), d=(c["cdn"], 1)) / 4.0,
        "seo": total(a=(has("title"), 1), b=(has("description"), 1), c=(has("analytics"), 1), d=(c["sitemap"], 1), e=(c["social"], 1), f=(has("language"), 1)) / 6.0,
        "practice": F.greatest(F.lit(0.0), 1.0 - 0.1 * F.size(F.filter(c["plugins"], lambda p: F.lower(p).isin(*DEPRECATED)))),
    }
    return {**parts, "overall": sum(parts.values(), F.lit(0.0)) / 5.0}


def converted(c: dict[str, Column], target: str) -> Column:
    """The settings that the generators share, written for another one; YAML, or JSON for GitBook."""
    names = {"Jekyll": ("title", "description", "url", "lang"), "Hugo": ("title", "description", "baseURL", "languageCode"), "GitBook": ("title", "description", "site", "language")}[target]
    values = [c[n] for n in ("title", "description", "url", "language")]
    if target == "GitBook":
        return F.to_json(F.struct(*[v.alias(n) for n, v in zip(names, values)]))
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'{n}: "'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"')) for n, v in zip(names, values)])), "\n")
