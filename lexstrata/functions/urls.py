"""URL normalisation and filters, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, let, trimmed


def _normal(p: Column) -> Column:
    """Normal form of the parts (scheme, hostport, tail) of an address."""
    scheme, hostport, tail = p["scheme"], p["hostport"], p["tail"]
    port = F.regexp_extract(hostport, r":([0-9]+)$", 1)
    host = F.regexp_replace(ascii_lower(F.regexp_replace(hostport, r":[0-9]*$", "")), r"\.$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(tail, r"^([^?]*)", 1)), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    plain = (port == "") | ((port == "80") & (scheme == "http")) | ((port == "443") & (scheme == "https"))
    out = F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~hostport.rlike(":[^0-9]*$"), out)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and one trailing slash dropped, slashes folded; null if not http(s)."""

    def parts(raw: Column) -> Column:
        full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
        cut = lambda f: F.struct(
            ascii_lower(F.regexp_extract(f, r"^([^:/]*)://", 1)).alias("scheme"), F.regexp_extract(f, r"^[^:/]*://([^/?]*)", 1).alias("hostport"), F.regexp_replace(f, r"^[^:/]*://[^/?]*", "").alias("tail")
        )
        return F.when(raw != "", let(let(full, cut), _normal))

    return let(trimmed(url), parts)


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(normalize_url(url), r"^https?://([^/:?]*)", 1), F.lit(""))


def dedup_key(url: Column) -> Column:
    return F.regexp_replace(normalize_url(url), r"^https?://(www\.)?", "")


def is_public(url: Column) -> Column:
    """False for local names and private address ranges."""

    def public(h: Column) -> Column:
        numbers = F.transform(F.split(F.regexp_extract(h, r"^(\d{1,9}\.\d{1,9}\.\d{1,9}\.\d{1,9})$", 1), r"\."), lambda x: x.try_cast("int"))
        a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))
        return h.isNotNull() & ~(h.isin("localhost", "::1") | h.endswith(".local")) & ~F.coalesce(private, F.lit(False))

    return F.coalesce(let(F.regexp_replace(host_of(url), r"^www\.", ""), public), F.lit(False))


# File endings of addresses that hold no page.
FILE_ENDINGS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico",
    ".bmp", ".mp3", ".mp4", ".m4a", ".wav", ".webm", ".avi", ".mov", ".wmv", ".css", ".js", ".mjs", ".map", ".json", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".exe",
    ".dmg", ".apk", ".iso", ".csv", ".tsv",
)


def url_path(url: Column) -> Column:
    """Path of the normal form, '/' if it has none; null if the address isn't http(s)."""
    return F.regexp_extract(normalize_url(url), r"^https?://[^/?]*(/[^?]*)", 1)


def skippable(url: Column) -> Column:
    """True if no address, or if the path has a file ending whose last occurrence no letter or digit follows."""

    def ends(low: Column) -> Column:
        out = F.lit(False)
        for e in FILE_ENDINGS:
            dot = e.replace(".", r"\.")
            out = out | low.rlike(rf"^(?s:.*){dot}(?![a-z0-9])(?!(?s:.*){dot})")
        return F.when(low.contains("."), out).otherwise(low.isNull())

    return F.coalesce(let(ascii_lower(url_path(url)), ends), F.lit(True))


def looks_like_page(url: Column) -> Column:
    """Whether an address has a path that no file ending marks as something else than a page."""
    return ~skippable(url)


def comparable_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    """False where either address has no host."""
    return F.coalesce(comparable_host(a) == comparable_host(b), F.lit(False))


def url_encode(text: Column) -> Column:
    """Letters, digits and -_.~| stay, blanks become '+', all other bytes %XX."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(text), "%7E", "~"), "%7C", "|"), r"\*", "%2A")


def url_decode(text: Column) -> Column:
    """%XX as bytes and '+' as a blank; a '%' without two hex digits stays. Bytes that aren't UTF-8 become replacement characters."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def resolve_url(base: Column, href: Column) -> Column:
    """Normal form of ``href`` as seen from ``base`` ('..' isn't folded); null for fragments, mail, script, data and phone links."""

    def target(h: Column) -> Column:
        def near(n: Column) -> Column:
            origin = F.regexp_extract(n, r"^(https?://[^/]*)", 1)
            folder = F.regexp_extract(F.regexp_replace(F.regexp_replace(n, r"^https?://[^/]*", ""), r"\?.*$", ""), r"^(.*/)", 1)
            return F.when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), h))

        whole = F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.contains("://"), h).otherwise(let(normalize_url(base), near))
        return F.when((h != "") & ~ascii_lower(h).rlike("^(#|mailto:|javascript:|data:|tel:)"), whole)

    return normalize_url(let(trimmed(href), target))


# The encyclopedia's host, and its mobile form.
ENCYCLOPEDIA, MOBILE = "en.wikipedia.org", "en.m.wikipedia.org"


def article_url(url: Column) -> Column:
    """Normal form; of the encyclopedia's pages https, one host, and no query."""

    def own(n: Column) -> Column:
        path = F.regexp_extract(n, r"^https?://[^/?]*(/[^?]*)", 1)
        host = F.regexp_extract(n, r"^https?://(?:www\.)?([^/:?]*)", 1)
        return F.when(host.isin(ENCYCLOPEDIA, MOBILE), F.concat(F.lit(f"https://{ENCYCLOPEDIA}"), path)).otherwise(n)

    return let(normalize_url(url), own)


def article_title(url: Column) -> Column:
    """Title of an article address, null for others."""
    return let(url_path(url), lambda path: F.when(path.startswith("/wiki/"), F.translate(url_decode(F.substring(path, 7, 1 << 30)), "+", " ")))


def title_url(title: Column) -> Column:
    return F.concat(F.lit(f"https://{ENCYCLOPEDIA}/wiki/"), url_encode(F.translate(trimmed(title), " ", "_")))


def page_title(raw: Column) -> Column:
    """A page's title without the site's name; Untitled if nothing is left."""
    t = trimmed(F.regexp_replace(trimmed(raw), " - Wikipedia$", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", "Untitled").otherwise(t)


def followed(url: Column) -> Column:
    """Whether a crawl of the encyclopedia follows the address: an article or hub, no other namespace."""
    from .text import SKIPPED_SPACES, title_space

    def good(canonical: Column) -> Column:
        title = F.translate(url_decode(F.regexp_extract(canonical, rf"^https://{re.escape(ENCYCLOPEDIA)}/wiki/(.+)$", 1)), "+", " ")
        return let(title, lambda t: (trimmed(t) != "") & let(title_space(t), lambda s: ~s.isin(*SKIPPED_SPACES) & ~s.endswith("_talk")))

    return F.coalesce(let(article_url(url), good), F.lit(False))


def news_title(url: Column, source: Column) -> Column:
    """The last part of the path as words (80 characters at most), after the source; without one, the source or the address."""
    last = F.regexp_extract(F.coalesce(url_path(url), F.lit("")), r"([^/]*)$", 1)

    def named(slug: Column) -> Column:
        s = F.coalesce(source, F.lit(""))
        return F.when(slug == "", F.when(s == "", url).otherwise(s)).when(s == "", slug).otherwise(F.concat(s, F.lit(": "), slug))

    return let(F.substring(F.translate(url_decode(last), "-_", "  "), 1, 80), named)
