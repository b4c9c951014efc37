"""Text extraction and statistics as Spark columns."""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.batches import by_slices

WORD_BREAK = r"[ \t\n\r]+"
CJK = r"[가-힣一-鿿぀-ゟ゠-ヿ]"
HANGUL, HAN, KANA = r"[가-힣]", r"[一-鿿]", r"[぀-ゟ゠-ヿ]"
#: Words that keyword search leaves out.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "는", "은", "이", "가", "을", "를", "에", "의", "와", "과", "으로", "로", "에서", "까지", "부터", "하다", "있다", "없다", "되다", "아니다",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_all(text: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def none_if_blank(text: Column) -> Column:
    return F.when(trim_all(text) != "", text)


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z0-9]+));")


def _character(found: re.Match) -> str:
    decimal, hexadecimal, name = found.groups()
    if name:
        return {"apos": "'"}.get(name) or chr(name2codepoint[name]) if name in name2codepoint or name == "apos" else found[0]
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]


def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _ENTITY.sub(_character, t) for t in texts.to_pylist()], pa.string())


def decode_entities(text: Column) -> Column:
    """Named and numeric character references that end in a semicolon; others stay.  Only texts with ``&`` leave the JVM."""
    needs = F.when(F.contains(text, F.lit("&")), text)
    return F.coalesce(by_slices(_decoded, "string", needs), text)


def _each_decoded(lists: pa.Array) -> pa.Array:
    made = ([None if t is None else _ENTITY.sub(_character, t) for t in texts or ()] for texts in lists.to_pylist())
    return pa.array(list(made), pa.list_(pa.string()))


def decode_each(texts: Column) -> Column:
    """``decode_entities`` of every text of an array, in one worker."""
    needs = F.when(F.exists(texts, lambda t: F.contains(t, F.lit("&"))), texts)
    return F.when(needs.isNotNull(), by_slices(_each_decoded, "array<string>", needs)).otherwise(texts)


def strip_tags(html: Column, by: str = "") -> Column:
    return F.regexp_replace(html, "<[^>]*>", by)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def reading_minutes(count: Column) -> Column:
    return F.greatest(F.lit(1.0), F.bround(count / 200.0, 1))


def reading_minutes_exact(count: Column) -> Column:
    return F.greatest(F.lit(1.0), count / 200.0)


def page_text(html: Column) -> Column:
    """Text of a page with a space for each tag, white space collapsed, references decoded."""
    return trim_all(decode_entities(F.regexp_replace(strip_tags(html, " "), r"(?U)\s+", " ")))


def visible_share(text: Column) -> Column:
    """Share of characters that aren't white space; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"(?U)\s", "")) / F.length(text)).otherwise(0.0)


def percent(value: Column) -> Column:
    """A share as whole percent, cut off."""
    return F.concat((value * 100).cast("int").cast("string"), F.lit("%"))


def reading_minutes_whole(count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / 200.0)).cast("long")


def title_of(html: Column, default: str = "Untitled") -> Column:
    found = trim_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def best_title(html: Column) -> Column:
    """h1 inside article or main, then title, then any h1."""

    inside = r"(?is)<(?:article|main)[^>]*>(?:(?!</(?:article|main)>).)*?<h1[^>]*>(.*?)</h1>"
    found = (strip_tags(F.regexp_extract(html, p, 1)) for p in (inside, r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"))
    titles = F.filter(F.transform(decode_each(F.array(*found)), trim_all), lambda t: t != "")
    return F.coalesce(F.get(titles, F.lit(0)), F.lit("Untitled"))


def markdown_headings(md: Column) -> Column:
    return F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^#{1,6}[ \t]+.+$"), F.lit(0)), trim_all)


def markdown_images(md: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(md, F.lit(r"!\[.*?\]\((.+?)\)"), F.lit(1)))


def description_of(md: Column) -> Column:
    lines = F.filter(F.split(md, "\n"), lambda x: (trim_all(x) != "") & ~F.startswith(trim_all(x), F.lit("#")))
    return truncate(F.array_join(F.slice(F.transform(lines, trim_all), 1, 3), " "), 300)


def title_from_text(text: Column) -> Column:
    """The first line that isn't blank, to 100 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")
    return truncate(F.get(lines, F.lit(0)), 100)


def description_from_text(text: Column) -> Column:
    """The first two sentences, to 300 characters."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]"), trim_all), lambda x: x != "")
    return truncate(F.array_join(F.slice(parts, 1, 2), ". "), 300)


def normalize_markdown(md: Column) -> Column:
    return trim_all(F.regexp_replace(md, r"\n{3,}", "\n\n"))


def preprocess(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(plain, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def postprocess(text: Column, least: int = 50, most: int | None = None) -> Column:
    flat = trim_all(F.regexp_replace(text, r"(?U)\s+", " "))
    flat = F.when(F.length(flat) < least, "").otherwise(flat)
    return F.left(flat, F.lit(most)) if most else flat


def plain_text(md: Column) -> Column:
    """Markdown without heading marks, emphasis, links and code marks."""
    out = F.regexp_replace(md, r"#{1,6}\s*", "")
    for pattern, by in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1")):
        out = F.regexp_replace(out, pattern, by)
    return out


def language_by_presence(text: Column) -> Column:
    return (
        F.when(F.coalesce(trim_all(text), F.lit("")) == "", "unknown")
        .when(text.rlike(HANGUL), "ko").when(text.rlike(KANA), "ja").when(text.rlike(HAN), "zh").otherwise("en")
    )


def language_by_share(text: Column, share: float = 0.1) -> Column:
    part = lambda p: F.regexp_count(text, F.lit(p)) / F.length(text)
    return F.when(F.coalesce(trim_all(text), F.lit("")) == "", "en").when(part(HANGUL) > share, "ko").when(part(KANA) > share, "ja").when(part(HAN) > share, "zh").otherwise("en")


def token_estimate(text: Column) -> Column:
    """A token for four characters, or for one and a half of Chinese, Japanese and Korean."""
    wide = F.regexp_count(text, F.lit(CJK))
    guess = F.ceil((F.length(text) - wide) / 4.0 + wide / 1.5)
    return F.when(F.coalesce(trim_all(text), F.lit("")) == "", 0).otherwise(guess).cast("long")


def count_tokens(text: Column, counter=None) -> Column:
    """Tokens by the caller's ``counter``, a column function such as a pandas UDF, else by estimate."""
    return token_estimate(text) if counter is None else counter(F.coalesce(text, F.lit(""))).cast("long")


def best_content(fit: Column, raw: Column, main: Column, text: Column) -> Column:
    return F.coalesce(*[none_if_blank(c) for c in (fit, raw, main, text)])


def word_set(words: Column) -> Column:
    """The different words of an array, lower-cased."""
    return F.array_distinct(F.transform(words, F.lower))


def jaccard_of_sets(x: Column, y: Column) -> Column:
    """Of two arrays without repeats; 1 for two empty ones."""
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(let(F.size(F.array_intersect(x, y)), lambda n: n / (both - n)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of words, lower-cased; 1 for two empty ones."""
    return let(F.struct(word_set(a).alias("x"), word_set(b).alias("y")), lambda s: jaccard_of_sets(s["x"], s["y"]))


def packed(text: str, size: int) -> list[str]:
    """Greedy packing of the words between spaces: a chunk closes when the next word would pass ``size``."""
    out, start, n, at = [], 0, 0, 0
    if not text.strip():
        return out
    for word in text.split(" "):
        if n and n + len(word) > size:
            out.append(text[start : at - 1])
            start, n = at, 0
        n += len(word) + 1
        at += len(word) + 1
    return [*out, text[start:]]


def by_text(cut, kind: str = "array<string>"):
    """A column function from ``cut``, a Python function from a text to a list, in Arrow batches; null gives an empty list."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return lambda text: by_slices(run, kind, text)


def split_by_size(text: Column, size: int) -> Column:
    """``packed`` of a column; one pass over each text."""
    return by_text(lambda t: packed(t, size))(text)
