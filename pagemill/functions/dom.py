"""A small HTML tree for the operators that need structure: parsing, simple selectors, text and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end an open element of the listed kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **{t: {"p"} for t in "p div ul ol table section article h1 h2 h3 h4 h5 h6 pre blockquote hr header footer nav aside main form figure".split()},
}
SCOPES = frozenset("table ul ol div section article body html td th blockquote main".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                todo.extend(reversed(item.children))
        return "".join(parts)

    def html_length(self) -> int:
        """Characters of the markup inside."""
        total, todo = 0, list(self.children)
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                total += len(item)
            else:
                total += 2 + len(item.tag) + sum(len(k) + len(v) + 4 for k, v in item.attrs.items())
                total += 0 if item.tag in VOID else 3 + len(item.tag)
                todo.extend(item.children)
        return total

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes, node = CLOSES.get(tag, ()), self.at
        while closes and node.parent and node.tag not in SCOPES - closes:
            if node.tag in closes:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SELECTOR = re.compile(r"^([a-z0-9]*)(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^*]?=)'([^']*)')?\])?$")


@lru_cache(maxsize=1024)
def _parts(selector: str) -> tuple:
    return _SELECTOR.match(selector).groups()


def matches(node: Node, selector: str) -> bool:
    """``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr='v']``, ``[attr^='v']``, ``[attr*='v']``, with a tag before or not."""
    tag, cls, ident, attr, how, value = _parts(selector)
    if tag and node.tag != tag:
        return False
    if cls:
        return cls in node.attrs.get("class", "").split()
    if ident:
        return node.attrs.get("id") == ident
    if attr:
        held = node.attrs.get(attr)
        if held is None or not how:
            return held is not None
        return held == value if how == "=" else held.startswith(value) if how == "^=" else value in held
    return bool(tag)


def select(root: Node, selectors: tuple[str, ...]) -> list[Node]:
    return [n for n in root.walk() if n.parent and any(matches(n, s) for s in selectors)]


def first(root: Node, *selectors: str) -> Node | None:
    """The first node of the first selector that has one."""
    for s in selectors:
        for n in root.walk():
            if n.parent and matches(n, s):
                return n
    return None


def absolute(root: Node, base: str) -> None:
    """Links and images made absolute; an image with a srcset gets its largest candidate as source."""
    for n in root.walk():
        if n.tag == "img" and n.attrs.get("srcset"):
            if best := best_source(n.attrs["srcset"]):
                n.attrs["src"] = best
                del n.attrs["srcset"]
        for name in ("href", "src"):
            if n.attrs.get(name) and n.tag in ("a", "img"):
                n.attrs[name] = urljoin(base or "", n.attrs[name])


def best_source(srcset: str) -> str | None:
    """The widest candidate, the first of equals: by ``w``, or a density counted as a thousand, else 0."""
    best, most = None, -1.0
    for part in srcset.split(","):
        url, _, size = part.strip().partition(" ")
        found = re.fullmatch(r"(?:([0-9]+)w|([0-9.]+)x)", size.strip())
        width = 0.0 if not found else float(found[1]) if found[1] else float(found[2]) * 1000
        if url and width > most:
            best, most = url, width
    return best


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def markdown(node: Node) -> str:
    """GitHub-flavoured Markdown of a tree; unknown tags pass their content on."""
    return re.sub(r"\n{3,}", "\n\n", _block(node, 0)).strip()


def _block(node: Node | str, depth: int) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    tag = node.tag
    if tag in ("pre",):
        return f"\n\n```\n{node.text().strip(chr(10))}\n```\n\n"
    if tag in ("ul", "ol"):
        rows, number = [], 0
        for item in (c for c in node.children if isinstance(c, Node) and c.tag == "li"):
            number += 1
            mark = f"{number}. " if tag == "ol" else "- "
            rows.append("  " * depth + mark + "".join(_block(c, depth + 1) for c in item.children).strip("\n ").replace("\n\n", "\n"))
        return ("\n\n" if depth == 0 else "\n") + "\n".join(rows) + ("\n\n" if depth == 0 else "")
    if tag == "table":
        rows = [[flat(c.text()).replace("|", r"\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join(lines[:1] + (["|" + " --- |" * len(rows[0])] if rows else []) + lines[1:]) + "\n\n"
    inner = "".join(_block(c, depth) for c in node.children)
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {flat(inner)}\n\n"
    if tag in ("strong", "b") and inner.strip():
        return f"**{inner.strip()}**"
    if tag in ("em", "i") and inner.strip():
        return f"*{inner.strip()}*"
    if tag == "code":
        return f"`{node.text()}`"
    if tag == "a":
        return f"[{flat(inner)}]({node.attrs['href']})" if node.attrs.get("href") and inner.strip() else inner
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + line for line in inner.strip().split("\n")) + "\n\n"
    if tag in ("p", "div", "section", "article", "main", "figure", "header", "footer", "body"):
        return f"\n\n{inner.strip()}\n\n"
    return inner
