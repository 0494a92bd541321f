"""Text functions and per-document style features, as column expressions.

Letters fold A-Z only and classes are ASCII, so results don't depend on a locale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embed import style_measures
from .kernels import STYLE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[ \t\n\x0B\f\r]"

# The stock phrases that count as formulaic.
STOCK_PHRASES = (
    "it is important to note",
    "in conclusion",
    "this article provides",
    "plays a crucial role",
    "in today's world",
    "a comprehensive overview",
    "it should be noted",
    "various factors",
    "in this article we will",
    "delve into",
)
# Substrings that decide a guessed topic, first match wins.
TOPIC_MARKS = (
    ("medicine", ("medicine", "clinical", "patient", "disease")),
    ("computer_science", ("algorithm", "computer", "software", "graph")),
    ("history", ("history", "empire", "war")),
    ("physics", ("physics", "quantum", "particle")),
    ("biology", ("biology", "genome", "species")),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def word_tokens(c: Column) -> Column:
    """Runs of letters, digits and apostrophes, folded."""
    return F.regexp_extract_all(ascii_lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def query_tokens(text: str) -> list[str]:
    import re

    return [t for t in re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if len(t) >= 3]


def guess_topic(c: Column) -> Column:
    """The first topic in order of which the folded text holds a mark, or general."""

    def first(low: Column) -> Column:
        out = F.lit("general")
        for topic, marks in reversed(TOPIC_MARKS):
            hit = low.contains(marks[0])
            for m in marks[1:]:
                hit = hit | low.contains(m)
            out = F.when(hit, topic).otherwise(out)
        return out

    return let(ascii_lower(c), first)


def year_of_date(c: Column) -> Column:
    """Leading 4 digits in 1900..2100, else the first isolated run of 4 digits in range, else 0."""
    ok = lambda y: y.between(1900, 2100)
    head = F.regexp_extract(c, r"^([0-9]{4})", 1).try_cast("int")
    runs = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)), lambda x: x.try_cast("int")), ok)
    return F.coalesce(F.when(ok(head), head), F.get(runs, F.lit(0)), F.lit(0))


def document_date(created: str = "created_at", published: str = "published_at") -> Column:
    """The created date if it has a year, else the published one if it has, else ''."""
    c, p = F.coalesce(created, F.lit("")), F.coalesce(published, F.lit(""))
    return F.when(year_of_date(c) > 0, c).when(year_of_date(p) > 0, p).otherwise(F.lit(""))


def recency_signal(date: Column) -> Column:
    """0 to 1 by the date's fixed places: year in 1-4, month in 6-7, day in 9-10; '' or no year 0.45."""
    lead = lambda at, n: F.regexp_extract(F.substring(date, at, n), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    y = lead(1, 4)
    m, d = F.coalesce(lead(6, 2), F.lit(1)), F.coalesce(lead(9, 2), F.lit(1))
    late = clip01(0.54 + 0.05 * F.least(F.lit(4), y - 2023) + m / 12.0 * 0.04)
    return (
        F.when((date == "") | y.isNull() | (y <= 0), 0.45).when(y < 2019, 0.0).when(y < 2022, 0.20)
        .when((y == 2022) & ((m < 11) | ((m == 11) & (d < 30))), 0.26).when(y == 2022, 0.48).otherwise(late)
    )


def style_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_count, type_token_ratio, sentence and punctuation features, repetition_score and char_entropy."""
    kept = [c for c in df.columns if c not in STYLE]
    return df.select(*kept, style_measures(text).alias("_m")).select(*kept, "_m.*")


def detectors(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds detector_stylometry, stock_phrases, detector_uniformity, detector_repetition from style features and char_entropy."""
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    hits = sum((low.contains(p).cast("int") for p in STOCK_PHRASES[1:]), low.contains(STOCK_PHRASES[0]).cast("int"))
    b, sd, rep = F.col("burstiness"), F.col("sentence_length_std"), F.col("repetition_score")
    style = 0.30 * clip01(1 - b / 1.2) + 0.25 * clip01(rep) + 0.25 * clip01(1 - sd / 18) + 0.20 * clip01((4.6 - F.col("char_entropy")) / 1.5)
    return (
        df.withColumn("detector_stylometry", clip01(style))
        .withColumn("stock_phrases", clip01(hits / 4.0))
        .withColumn("detector_uniformity", clip01(0.6 * (1 - b / 1.1) + 0.4 * (1 - sd / 16)))
        .withColumn("detector_repetition", clip01(rep * 1.4))
    )


# Title namespaces that hold no articles (talk spaces besides).
SKIPPED_SPACES = (
    "special", "file", "image", "talk", "user", "wikipedia", "wp", "help", "template", "module", "mediawiki", "draft", "timedtext", "media",
    "education_program", "gadget", "gadget_definition",
)
HUB_SPACES = ("category", "portal")


def title_space(title: Column) -> Column:
    """What stands before the first colon, folded, '_' for blanks; '' if nothing does."""
    return F.translate(ascii_lower(F.regexp_extract(F.coalesce(title, F.lit("")), r"^([^:]+):", 1)), " ", "_")


def is_article_title(title: Column) -> Column:
    space = title_space(title)
    return (trimmed(F.coalesce(title, F.lit(""))) != "") & ~space.isin(*SKIPPED_SPACES, *HUB_SPACES) & ~space.endswith("_talk")


def is_disambiguation(title: Column, text: Column) -> Column:
    """By the title's mark, or an opening of 180 characters that says so in a text of under 120 words."""
    head = ascii_lower(F.substring(F.coalesce(text, F.lit("")), 1, 180))
    return ascii_lower(F.coalesce(title, F.lit(""))).contains("(disambiguation)") | (head.contains("may refer to") & (F.size(word_tokens(F.coalesce(text, F.lit("")))) < 120))


def same_text(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def starts_with(text: Column, prefix: str) -> Column:
    return ascii_lower(F.substring(text, 1, len(prefix))) == prefix.translate(str.maketrans(UPPER, LOWER))


def clip_bytes(text: Column, n: int) -> Column:
    """The longest prefix of whole characters of at most ``n`` bytes."""
    head = F.substring(text, 1, n)
    # A prefix of k characters has at most 4 k bytes; of the lengths that are left the greatest that fits counts.
    sizes = F.sequence(F.greatest(F.least(F.length(head), F.lit(n // 4)), F.lit(0)), F.length(head))
    fits = F.array_max(F.filter(sizes, lambda k: F.octet_length(F.substring(head, F.lit(1), k)) <= n))
    return F.when(F.octet_length(head) <= n, head).otherwise(F.substring(head, F.lit(1), fits))


def split_csv(text: Column) -> Column:
    """Parts between commas, trimmed, empty ones left out; null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed), lambda p: p != "")


def signals_json(names: dict[str, str]) -> Column:
    """A JSON object of signal columns in thousandths, by key in order; nulls are left out."""
    return F.to_json(F.struct(*(F.round(F.round(F.col(c), 9), 3).alias(k) for k, c in sorted(names.items()))))


def parsed_signal(json: Column, key: str) -> Column:
    """The number of a key of a signals text, 0 if it isn't there."""
    return F.coalesce(F.get_json_object(json, f"$.{key}").try_cast("double"), F.lit(0.0))


def number_text(v: Column, digits: int = 2) -> Column:
    """A number with 0, 1 or 2 places; halves go to the even digit."""
    digits = min(max(digits, 0), 2)
    return F.format_string(f"%.{digits}f", F.bround(v.cast("double"), digits))


def times_text(after: Column, before: Column) -> Column:
    """How many times as high ``after`` is, in words; within 8 % it is about the same."""
    r = after / F.greatest(before, F.lit(1e-300))
    out = F.when((before < 1e-4) & (after < 1e-4), "about the same as").when(before < 1e-4, "much higher than")
    out = out.when(r >= 1.08, F.concat(number_text(r, 1), F.lit("x as high as"))).when(r <= 0.92, F.concat(number_text(r * 100, 0), F.lit("% as high as")))
    return out.otherwise("about the same as")


def change_text(after: Column, before: Column) -> Column:
    """The relative change in words; within 3 % it is little. From near zero only a difference of 0.02 counts."""
    rel = (after - before) / F.greatest(F.abs(before), F.lit(1e-300))
    near = F.when(after > before + 0.02, "rose from near zero").when(after + 0.02 < before, "fell toward zero").otherwise("barely moved")
    moved = F.when(rel >= 0.03, F.concat(F.lit("rose "), number_text(rel * 100, 0), F.lit("%"))).when(rel <= -0.03, F.concat(F.lit("fell "), number_text(-rel * 100, 0), F.lit("%")))
    return F.when(F.abs(before) < 1e-4, near).otherwise(F.coalesce(moved, F.lit("changed little")))


def score_label(p: Column, band: Column) -> Column:
    """A page's score in whole percent and its band in words; '' without a score."""
    words = F.when(band == "LIKELY_AI", ", likely AI-generated").when(band == "LIKELY_HUMAN", ", likely human-written").when(band == "UNCERTAIN", ", uncertain").otherwise("")
    return F.when(p.isNull(), "").otherwise(F.concat(F.floor(F.round(p * 100, 9) + 0.5).cast("string"), F.lit("%"), words))


def _shortened(clean: Column, longest: int, cut: int) -> Column:
    return F.when(F.length(clean) <= longest, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, cut), r"\s+\S*$", ""), F.lit("…")))


def clip_sentence(text: Column, longest: int) -> Column:
    """The text on one line without leading dots, cut after a word of its first ``longest`` characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), "^…+", ""))
    return let(clean, lambda c: _shortened(c, longest, longest))


def gist(text: Column, title: Column) -> Column:
    """One line of a page's text or else title: addresses and slugs as words, at most 180 characters; Untitled if there is nothing."""
    raw = F.coalesce(F.nullif(text, F.lit("")), F.nullif(title, F.lit("")), F.lit("Untitled"))
    line = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def spoken(r: Column) -> Column:
        address = r.rlike("(?i)^https?://") | (r.rlike("(?i)^[a-z0-9.-]+/") & ~r.contains(" "))
        words = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(r, "(?i)^https?://", ""), r"[?#].*$", ""), "[/_-]+", " "), ".", " ")
        return F.when(address, words).when(r.contains("-") & ~r.contains(" "), F.regexp_replace(r, "[-_]+", " ")).otherwise(r)

    return let(line(let(line(raw), spoken)), lambda s: F.coalesce(F.nullif(_shortened(s, 180, 176), F.lit("")), F.lit("Untitled")))
