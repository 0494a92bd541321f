"""Pages of a crawl: entities, title and body text, links, dates, categories (Arrow batches)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_lower, let, trimmed
from .urls import article_url, followed, host_of, looks_like_page, normalize_url, resolve_url, same_host

# The named references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# Regions left out of the text, by a word of their class and by their id.
SKIPPED_CLASSES = frozenset(
    "mw-editsection reflist mw-references-wrap navbox vertical-navbox infobox hatnote sidebar shortdescription sistersitebox mw-indicators thumb toc".split()
)
SKIPPED_IDS = frozenset("toc catlinks mw-hidden-catlinks mw-navigation footer".split())
# Tags that stand for a blank, and tags whose content isn't read.
BLANK_TAGS = frozenset("br p div li tr h1 h2 h3 h4".split())
SILENT = frozenset("script style noscript".split())
_FOLD = {c: c + 32 for c in range(65, 91)}
_REFERENCE = re.compile(r"&([^;&]{0,9});")
_TAG = re.compile(r"<(/?)([A-Za-z0-9:_-]*)([^>]*)>?", re.S)
_BLANK = " \t\n\x0b\f\r"
_GAPS = re.compile(rf"[{_BLANK}]+")


def _reference(m: re.Match) -> str:
    name = m[1]
    if name in NAMED:
        return NAMED[name]
    if not name.startswith("#"):
        return m[0]
    number = re.match(r"[xX]([0-9A-Fa-f]+)|([0-9]+)", name[1:])
    code = int(number[1], 16) if number and number[1] else int(number[2]) if number else 0
    return chr(code) if 0 < code <= 0xFFFF and not 0xD800 <= code < 0xE000 else " "


def unescape(text: str) -> str:
    """Six named references and numbers up to U+FFFF; other numbers are a blank, other names stay. The ';' must be near."""
    return _REFERENCE.sub(_reference, text)


@F.arrow_udf(T.StringType())
def html_unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unescape(t) for t in text.to_pylist()], pa.string())


def _attribute(attrs: str, low: str, name: str) -> str:
    at = low.find(name + "=")
    if at < 0:
        return ""
    rest = attrs[at + len(name) + 1 :].lstrip(_BLANK)
    if rest[:1] in ("'", '"'):
        end = rest.find(rest[0], 1)
        return unescape(rest[1:end]) if end > 0 else ""
    return unescape(re.match(rf"[^{_BLANK}/>]*", rest)[0])


@dataclass
class Page:
    """What a page holds. wiki_text: the article region's text, or all of it; footer: the last-change line, or all text."""

    title: str = ""
    body: str = ""
    wiki_text: str = ""
    footer: str = ""
    modified: str = ""
    time: str = ""
    hrefs: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)


def _collapsed(parts: list[str]) -> str:
    return _GAPS.sub(" ", "".join(parts)).strip(_BLANK)


def _add(parts: list[str], text: str) -> None:
    if parts and parts[-1][-1] not in _BLANK and text[0] not in _BLANK:
        parts.append(" ")
    parts.append(text)


def parse_page(html: str) -> Page:
    """A walk over tags: regions open at a tag that isn't self-closing and end with it or an outer one. Unclosed tags stay open."""
    page = Page()
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, skipped, article, categories, last change
    inside = [0, 0, 0, 0]
    title: list[str] = []
    body: list[str] = []
    wiki: list[str] = []
    footer: list[str] = []
    in_title = False

    def text(raw: str) -> None:
        decoded = unescape(raw)
        if not decoded:
            return
        if in_title:
            title.append(decoded)
        if inside[0]:
            return
        _add(body, decoded)
        if inside[1]:
            _add(wiki, decoded)
        if inside[3]:
            footer.append(decoded)

    def close(depth: int) -> None:
        while len(stack) > depth:
            for i, on in enumerate(stack.pop()[1:]):
                inside[i] -= on

    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            if inside[2] and stack[-1][0] == "a" and (name := unescape(html[at:end]).strip(_BLANK)):
                page.categories.append(name)
            text(html[at:end])
            at = end
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(html, at)
        closing, tag, attrs = m[1] == "/", m[2].translate(_FOLD), m[3]
        at = m.end()
        if tag in SILENT and not closing:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            gt = html.find(">", end.start()) if end else -1
            at = n if gt < 0 else gt + 1
            continue
        if closing:
            in_title = in_title and tag != "title"
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth)
            continue
        if tag in BLANK_TAGS:
            text(" ")
        low = attrs.translate(_FOLD)
        get = lambda name: _attribute(attrs, low, name)  # noqa: E731, B023
        ident, names = get("id").translate(_FOLD), get("class").translate(_FOLD)
        words = set(names.split())
        if tag == "a" and (href := get("href")):
            page.hrefs.append(href)
        elif tag == "meta":
            prop = get("property").translate(_FOLD)
            if (prop in ("article:modified_time", "og:updated_time", "article:published_time") or get("name").translate(_FOLD) == "last-modified") and not page.modified:
                page.modified = get("content")
        elif tag == "time" and not page.time:
            page.time = get("datetime")
        elif tag == "title":
            in_title = True
        if "/" not in attrs[-1:]:
            skipped = bool(words & SKIPPED_CLASSES) or ident in SKIPPED_IDS or (tag == "sup" and "reference" in names)
            article = ident == "mw-content-text" or "mw-parser-output" in names
            changed = ident in ("footer-info-lastmod", "mw-revision-date") or "mw-last-modified" in names
            frame = (tag, skipped, article, ident == "mw-normal-catlinks", changed)
            stack.append(frame)
            for i, on in enumerate(frame[1:]):
                inside[i] += on
    page.title, page.body = unescape("".join(title)).strip(_BLANK), _collapsed(body)
    page.wiki_text = _collapsed(wiki) if wiki else page.body
    page.footer = _collapsed(footer) or page.body
    return page


#: Fields of a parsed page, in order; the last two are lists.
PAGE = ("title", "body", "wiki_text", "footer", "modified", "time", "hrefs", "categories")
_LISTS = PAGE[6:]
#: Pages held as Python objects at a time.
PARSED = 128


@F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in _LISTS else T.StringType()) for c in PAGE]))
def parse_html(html: pa.Array) -> pa.Array:
    """Title, texts, dates, links and categories of each page; null html is an empty page."""
    kinds = {k: pa.list_(pa.string()) if k in _LISTS else pa.string() for k in PAGE}
    parts = {k: [pa.array([], kind)] for k, kind in kinds.items()}
    for at in range(0, len(html), PARSED):
        pages = [parse_page(h or "") for h in html.slice(at, PARSED).to_pylist()]
        for k, kind in kinds.items():
            parts[k].append(pa.array([getattr(p, k) for p in pages], kind))
    return pa.StructArray.from_arrays([pa.concat_arrays(parts.pop(k)) for k in PAGE], names=list(PAGE))


def _distinct(links: Column, own: Column) -> Column:
    return F.array_distinct(F.filter(links, lambda x: x.isNotNull() & ~F.coalesce(x == own, F.lit(False))))


def same_host_links(url: Column, hrefs: Column) -> Column:
    """Pages of the same host that ``hrefs`` lead to, but for the page itself, in order, each once; files are left out."""
    near = lambda own: lambda x: F.when(same_host(own, x) & looks_like_page(x), x)
    return let(normalize_url(url), lambda own: _distinct(F.transform(hrefs, lambda h: let(resolve_url(own, h), near(own))), own))


def article_links(url: Column, hrefs: Column) -> Column:
    """Articles of the encyclopedia that ``hrefs`` lead to, but for the page itself, in order, each once."""
    good = lambda x: F.when(followed(x), x)
    return let(article_url(url), lambda own: _distinct(F.transform(hrefs, lambda h: let(article_url(resolve_url(own, h)), good)), own))


# The news project's host.
PROJECT = "gdeltproject.org"


def project_links(url: Column, hrefs: Column) -> Column:
    """Pages of the news project that ``hrefs`` lead to, from a page of it, in order, each once."""
    site = lambda u: F.when(F.coalesce(host_of(u).rlike(rf"(^|\.){re.escape(PROJECT)}$"), F.lit(False)) & looks_like_page(u), u)
    found = lambda own: _distinct(F.transform(hrefs, lambda h: let(resolve_url(own, h), site)), own)
    return let(let(normalize_url(url), site), lambda own: F.when(own.isNotNull(), found(own)).otherwise(F.array().cast("array<string>")))


# Month names by their first three letters, in order.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def iso_date(raw: Column) -> Column:
    """The first 10 characters of a date text with '-' in the 5th and 8th place, or null."""
    value = trimmed(raw)
    return F.when(value.rlike(r"^(?s:.{4}-.{2}-.{2})"), F.substring(value, 1, 10))


def last_change(text: Column) -> Column:
    """YYYY-MM-DD of "last edited on 5 March 2021" or "... March 5, 2021" in a page's text; null without one."""
    head = r"(?i)last (?:edited|modified) on[ \t\n\x0B\f\r]+"
    day_first, month_first = head + r"([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})", head + r"([A-Za-z]+)\s+([0-9]{1,2}),\s+([0-9]{4})"
    first = F.regexp_extract(text, day_first, 1) != ""
    pick = lambda a, b: F.when(first, F.regexp_extract(text, day_first, a)).otherwise(F.regexp_extract(text, month_first, b))
    day, month, year = pick(1, 2), ascii_lower(F.substring(pick(2, 1), 1, 3)), pick(3, 3)
    number = F.array_position(F.array(*map(F.lit, _MONTHS)), month)
    return F.when((day != "") & (number > 0), F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def published(page: Column, header: Column) -> Column:
    """A page's date: its last-change line, else its meta or time tag, else the response's header."""
    return F.coalesce(last_change(page["footer"]), iso_date(page["modified"]), iso_date(page["time"]), iso_date(header))


def stamp_date(stamp: Column) -> Column:
    """YYYY-MM-DD from the first 8 digits wherever they stand, or ''."""
    digits = F.regexp_replace(F.coalesce(stamp, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise("")


def stamp_before(stamp: Column, minutes: int = 15) -> Column:
    """The stamp yyyymmddHHMM00 ``minutes`` earlier; '' for stamps under 12 digits."""
    at = F.try_to_timestamp(F.substring(stamp, 1, 12), F.lit("yyyyMMddHHmm"))
    return F.coalesce(F.date_format(at - F.expr(f"INTERVAL {minutes} MINUTES"), "yyyyMMddHHmm'00'"), F.lit(""))


def news_text(title: Column, url: Column, stamp: Column, domain: Column, country: Column, language: Column, topic: Column) -> Column:
    """The text that stands for a news item: its fields in sentences, empty ones left out."""
    date = stamp_date(stamp)
    part = lambda c, before, after=".": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    # Fixed value: the item's sentences.
    return F.concat(
        F.lit('GDELT Project monitored news item titled "'), title, F.lit('".'), part(date, " Seen on "), part(domain, " Published by "), part(country, " Source country "),
        part(language, " Language "), F.lit(" Topic label "), topic,
        F.lit(". Collected from the GDELT Project document API on api.gdeltproject.org. The GDELT Project monitors worldwide news coverage. "), part(url, "Original article URL: "),
    )


