"""Reports over scored documents: subject mix, year span, era cohorts by topic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexstrata.functions.embed import centroids, cosine
from lexstrata.functions.text import ascii_lower, trimmed, year_of_date
from lexstrata.functions.topics import is_country, shown, with_view_topics
from lexstrata.operators.views import percent, sample_evenly, third
from lexstrata.storage import materialize

# Subjects and the patterns that decide them in lower-case text, first match wins.
SUBJECTS = (
    ("sports", r"sport|cricket|football|soccer|hockey|olympi|tennis|rugby|basketball|mlb|nfl|nba|premier league|bundesliga|afl|nrl|athlet|world cup|fifa"),
    ("food and cooking", r"cuisine|food|dish|recipe|cook|restaurant|gastronom|kitchen"),
    ("schools and universities", r"educat|universit|school|college|student|academ|campus"),
    (
        "politics and government",
        r"politic|election|parliament|congress|government|minister|president|senate|chancellor|constitution|supreme court|democrat|republican|bundestag|lok sabha|rajya sabha",
    ),
    ("history", r"history|\bwar\b|empire|dynasty|independence|ancient|medieval|colonial|revolution"),
    ("places and geography", r"geograph|river|mountain|climate|ocean|national park|city|cities|state of|province|district|capital"),
    ("economy and transport", r"econom|compan|industry|trade|bank|transport|railway|airport|gdp"),
    ("arts, language, and culture", r"culture|cinema|film|music|literature|language|festival|bollywood|sanskrit|hindi|tamil|kannada|bengali|telugu|marathi"),
    ("religion", r"religion|hindu|islam|christian|sikh|church|temple|buddh"),
    ("science and technology", r"science|technolog|computer|software|physics|chemist|biolog"),
    ("health", r"health|medic|hospital|disease|covid"),
    ("news and media", r"news|announcing|press release|the gdelt project"),
    ("people", r"people of|biography"),
)
# Cohort traits, the column each averages, and whether more of it points to generated text.
TRAITS = (
    ("p_ai", "p_ai", True),
    ("stock_phrases", "stock", True),
    ("sentence_uniformity", "detector_uniformity", True),
    ("ngram_repetition", "detector_repetition", True),
    ("embedding_anomaly", "anomaly", True),
    ("stylometry", "detector_stylometry", True),
    ("pre2019_centroid_distance", "_far", True),
    ("sentence_length_variance", "sentence_length_std", False),
    ("burstiness", "burstiness", False),
)
TRAIT_MARGIN = 0.02
ANY_SUBJECT = "|".join(pattern for _, pattern in SUBJECTS)


def _subjects(texts: pa.Array) -> pa.Array:
    """One pass finds the texts that have a subject at all; only those meet the patterns one by one."""
    low = pc.utf8_lower(texts)
    found = np.full(len(low), "", dtype=object)
    left = np.flatnonzero(pc.match_substring_regex(low, ANY_SUBJECT).fill_null(False))
    low = low.take(pa.array(left))
    for name, pattern in SUBJECTS:
        hit = np.asarray(pc.match_substring_regex(low, pattern))
        found[left[hit]] = name
        left, low = left[~hit], low.filter(pa.array(~hit))
    return pa.array(found, pa.string())


def subject_of(text: Column) -> Column:
    """First subject whose pattern occurs, or ''. Null text has none; word bounds are ASCII."""

    # As Spark's own patterns, 175 MB of texts took 37 to 46 s on 8 cores.
    @F.arrow_udf(T.StringType())
    def subject(texts: pa.Array) -> pa.Array:
        return _subjects(texts)

    return subject(text)


def subject_mix(docs: DataFrame) -> DataFrame:
    """told_by, subject, documents, share of all rows (those without a subject too), mean p_ai.

    told_by: title (from column ``subject``) or text (from ``text_subject``); each row counts once in either.
    """
    both = F.array(*(F.struct(F.lit(by).alias("told_by"), F.col(c).alias("subject")) for by, c in (("title", "subject"), ("text", "text_subject"))))
    groups = docs.select("p_ai", F.inline(both)).groupBy("told_by", "subject").agg(F.count("*").alias("documents"), F.round(F.avg("p_ai"), 6).alias("mean"))
    groups = materialize(groups, "subjects")
    total = groups.where("told_by = 'title'").agg(F.sum("documents").alias("n"))
    share = F.round(F.col("documents") / F.col("n"), 6)
    return groups.where("subject <> ''").join(F.broadcast(total), F.lit(True)).select("told_by", "subject", "documents", share.alias("share"), "mean")


def year_span(docs: DataFrame, peak: float = 0.6) -> DataFrame:
    """One row: dated, first and last year, the commonest (the earliest of equals), its share, and if that reaches ``peak``."""
    years = docs.where("year > 0").groupBy("year").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("year")).alias("y")))
    span = years.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dated"), F.min("year").alias("first"), F.max("year").alias("last"), top.alias("_top"))
    share = F.try_divide(F.col("_top.n"), F.col("dated"))
    return span.select("dated", "first", "last", (-F.col("_top.y")).alias("mode_year"), F.round(share, 6).alias("peak_share"), F.coalesce(share >= peak, F.lit(False)).alias("peaked"))


def cohort_pools(docs: DataFrame, least: int = 100, size: int = 50) -> DataFrame:
    """topic, documents, dated, before_pool, after_pool, ready: topics of ``least`` documents or more."""
    pools = docs.where("topic <> ''").groupBy("topic").agg(
        F.count("*").alias("documents"), F.count_if(F.col("year") > 0).alias("dated"),
        F.count_if(F.col("year").between(1, 2018)).alias("before_pool"), F.count_if(F.col("year") >= 2019).alias("after_pool"),
    )
    return pools.where(F.col("documents") >= least).withColumn("ready", F.least("before_pool", "after_pool") >= size)


def cohort_traits(docs: DataFrame, least: int = 100, size: int = 50) -> DataFrame:
    """topic, trait, before, after, ai_like: trait means of ``size`` documents at even steps from before 2019 and from then on.

    ``docs`` carry their collection's scores. Distances are to the centroid of the earlier sample.
    ai_like: the later mean differs by more than TRAIT_MARGIN towards generated text.
    """
    ready = cohort_pools(docs, least, size).where("ready").select("topic")
    rows = docs.where("year > 0").join(ready, "topic", "left_semi").withColumn("_late", F.col("year") >= 2019)
    sample = sample_evenly(rows.withColumn("_pool", F.struct("topic", "_late")), "_pool", size).drop("_pool")
    middle = centroids(sample.where("NOT _late"), ["topic"], "embedding")
    far = sample.join(middle, "topic").withColumn("_far", 1 - cosine(F.col("embedding"), F.col("centroid")))
    value = lambda c: third(F.col(c)) if c == "stock" else F.col(c)
    side = lambda c, late: F.round(F.coalesce(F.avg(F.when(F.col("_late") == late, value(c))), F.lit(0.0)), 6)
    means = far.groupBy("topic").agg(*(side(c, late).alias(f"{k}_{late}") for k, c, _ in TRAITS for late in (False, True)))
    pairs = [F.struct(F.lit(k).alias("trait"), F.col(f"{k}_False").alias("before"), F.col(f"{k}_True").alias("after"), F.lit(up).alias("up")) for k, _, up in TRAITS]
    more, fewer = F.col("after") - F.col("before") > TRAIT_MARGIN, F.col("before") - F.col("after") > TRAIT_MARGIN
    return means.select("topic", F.inline(F.array(*pairs))).select("topic", "trait", "before", "after", F.when(F.col("up"), more).otherwise(fewer).alias("ai_like"))


def merge_breakdown(rows: DataFrame) -> DataFrame:
    """Partial breakdown rows (key, documents, mean, low, high) as one for each key.

    Means are weighted by documents and rounded once; rows with a null mean count as documents
    only. The range spans all partial ranges. Rows without a key go.
    """
    weight = F.when(F.col("mean").isNotNull(), F.col("documents"))
    return rows.where("key <> ''").groupBy("key").agg(
        F.sum("documents").alias("documents"), F.round(F.try_divide(F.sum(F.col("mean") * weight), F.sum(weight)), 6).alias("mean"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def strongest_detector(scored: DataFrame) -> DataFrame:
    """The detector of greatest mean, the first of equals; uniformity and recency don't take part."""
    names = {"stylometry": "detector_stylometry", "stock": "stock", "ngram": "detector_repetition", "anomaly": "anomaly", "deviation": "deviation"}
    means = scored.agg(*(third(F.avg(third(F.col(c)) if k == "stock" else c)).alias(k) for k, c in names.items()))
    rows = means.select(F.inline(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("score"), F.lit(i).alias("i")) for i, c in enumerate(names)))))
    return rows.where("score IS NOT NULL").orderBy(F.desc("score"), "i").limit(1).select("key", "score")


def top_group(docs: DataFrame, by: str, value: str, least: int = 100) -> DataFrame:
    """key, percent, documents of the group of greatest mean in whole percent, then of most documents, then by key.

    Groups need ``least`` documents and a value; no row if there are fewer than two groups of any size.
    """
    groups = docs.where(F.coalesce(trimmed(F.col(by)), F.lit("")) != "").groupBy(trimmed(F.col(by)).alias("key")).agg(F.count("*").alias("documents"), F.avg(value).alias("mean"))
    many = groups.agg(F.count("*").alias("groups")).where("groups >= 2")
    rows = groups.where((F.col("documents") >= least) & F.col("mean").isNotNull()).join(F.broadcast(many), F.lit(True))
    percent = F.floor(F.round(F.col("mean") * 100, 6) + 0.5)
    return rows.select("key", percent.alias("percent"), "documents").orderBy(F.desc("percent"), F.desc("documents"), "key").limit(1)


def merge_years(first: DataFrame, second: DataFrame, since: int = 2015, now: int = 2026) -> DataFrame:
    """A row (year, documents, mean) for every year from ``since`` to the last one with data.

    Where both tables have a year, the second's row counts if it has more documents, or a mean that the first lacks.
    """
    sides = [df.where(F.col("year").between(since, now)).select("year", F.col("documents").alias(f"n{k}"), F.col("mean").alias(f"m{k}"), F.lit(True).alias(f"h{k}")) for k, df in enumerate((first, second))]
    both = sides[0].join(sides[1], "year", "full")
    later = F.col("h0").isNull() | (F.col("h1").isNotNull() & ((F.coalesce("n1", F.lit(0)) > F.coalesce("n0", F.lit(0))) | (F.col("m0").isNull() & F.col("m1").isNotNull())))
    pick = lambda c: F.when(later, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    rows = both.select("year", F.coalesce(pick("n"), F.lit(0)).alias("documents"), pick("m").alias("mean"))
    axis = rows.where("documents > 0 OR mean IS NOT NULL").agg(F.max("year").alias("last")).where("last IS NOT NULL")
    years = axis.select(F.explode(F.sequence(F.lit(since), F.col("last"))).alias("year"))
    return years.join(rows, "year", "left").select("year", F.coalesce("documents", F.lit(0)).alias("documents"), "mean")


def collapsed_dates(docs: DataFrame, filler: int = 2016) -> DataFrame:
    """dataset_id, documents, bad, years, collapsed: half the creation years missing or ``filler``, or one year at most."""
    year = F.coalesce(F.regexp_extract(F.coalesce("created_at", F.lit("")), r"^([0-9]{4})", 1).try_cast("int"), F.lit(0))
    rows = docs.withColumn("_y", year).groupBy("dataset_id").agg(
        F.count("*").alias("documents"), F.count_if((F.col("_y") <= 0) | (F.col("_y") == filler)).alias("bad"), F.count_distinct(F.when(F.col("_y") > 0, F.col("_y"))).alias("years")
    )
    return rows.withColumn("collapsed", (2 * F.col("bad") >= F.col("documents")) | (F.col("years") <= 1))


def cards(stored: DataFrame, size: int = 320) -> DataFrame:
    """Document cards from stored scores: '' as null, scores in thousandths, missing signals as 0, view topics, the first ``size`` characters.

    Columns: those of a stored, scored document and text.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in stored.columns else F.lit(None).cast("string")
    signals = {"stylometry": "detector_stylometry", "stock_phrase": "stock", "sentence_uniformity": "detector_uniformity", "ngram_repetition": "detector_repetition", "embedding_anomaly": "anomaly", "stylometry_deviation": "deviation", "post_chatgpt": "recency"}
    return with_view_topics(stored).select(
        "id", "title", blank("url").alias("url"), "source", "topic", F.nullif("subtopic", F.lit("")).alias("subtopic"), blank("published_at").alias("published_at"),
        blank("created_at").alias("created_at"), "word_count", *(third(F.col(c)).alias(c) for c in ("p_ai", "ci_low", "ci_high")), F.coalesce("band", F.lit("PENDING")).alias("band"),
        *((third(F.coalesce(c, F.lit(0.0))) if k in ("stock_phrase", "post_chatgpt") else F.coalesce(c, F.lit(0.0))).alias(k) for k, c in signals.items()),
        F.substring("text", 1, size).alias("excerpt"),
    )


def year_ranges(docs: DataFrame) -> DataFrame:
    """year, documents, mean, low, high of scored documents with a year: low and high are the least and greatest score."""
    rows = docs.where("year > 0 AND p_ai IS NOT NULL").groupBy("year")
    return rows.agg(F.count("*").alias("documents"), percent(F.avg("p_ai")).alias("mean"), percent(F.min("p_ai")).alias("low"), percent(F.max("p_ai")).alias("high"))


# Subjects that are told of even where they are thin.
THIN_SUBJECTS = ("schools and universities", "sports", "food and cooking")


def corpus_lines(nodes: DataFrame) -> DataFrame:
    """(line, key, documents, place): what a view's pages are, as ranked counts.

    line: collection, subject (the three largest), thin (those of THIN_SUBJECTS beyond them), text_subject (all), country,
    and news_only (countries without a page of the encyclopedia). Columns: collection, topic, subject, text_subject.
    """
    wiki = ascii_lower(F.col("collection")).contains("wiki")
    kinds = F.array(
        F.struct(F.lit("collection").alias("line"), F.col("collection").alias("key")), F.struct(F.lit("subject").alias("line"), F.col("subject").alias("key")),
        F.struct(F.lit("text_subject").alias("line"), F.col("text_subject").alias("key")),
        F.struct(F.lit("country").alias("line"), F.when(is_country(F.col("topic")), shown(F.col("topic"))).alias("key")),
    )
    rows = nodes.select(wiki.alias("_wiki"), F.inline(kinds)).where("coalesce(key, '') <> ''").groupBy("line", "key").agg(F.count("*").alias("documents"), F.count_if("_wiki").alias("_wiki"))
    rows = materialize(rows, "lines")
    place = F.row_number().over(Window.partitionBy("line").orderBy(F.desc("documents"), "key"))
    ranked = rows.withColumn("place", place)
    thin = ranked.where((F.col("line") == "subject") & (F.col("place") > 3) & F.col("key").isin(*THIN_SUBJECTS)).withColumn("line", F.lit("thin"))
    news = ranked.where("line = 'country' AND _wiki = 0").withColumn("line", F.lit("news_only"))
    return ranked.where("line <> 'subject' OR place <= 3").unionByName(thin).unionByName(news).drop("_wiki")


def calculations(summary: DataFrame, years: DataFrame, size: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row that traces a view's percent: pending documents, shares and ranges, cutoffs, first, last and peak year, graph size.

    ``summary``: views.summary; ``years``: views.by_year; ``size``: graph.graph_size; ``corpus``: one row (corpus).
    The peak is the first year of the greatest percent.
    """
    shares = years.where("mean IS NOT NULL").select("year", "documents", percent(F.col("mean")).alias("percent"))
    bins = shares.agg(
        F.count("*").alias("bins_with_mean"), F.min(F.struct("year", "percent", "documents")).alias("first"), F.max(F.struct("year", "percent", "documents")).alias("last"),
        F.max(F.struct("percent", (-F.col("year")).alias("y"), "documents")).alias("peak"),
    )
    one = summary.join(F.broadcast(bins), F.lit(True)).join(F.broadcast(years.agg(F.count("*").alias("bins"))), F.lit(True)).join(F.broadcast(size), F.lit(True)).join(F.broadcast(corpus), F.lit(True))
    done = F.col("likely_ai") + F.col("likely_human") + F.col("uncertain")
    return one.select(
        "corpus", "documents", done.alias("scored"), F.greatest(F.col("documents") - done, F.lit(0)).alias("pending"), "likely_ai", "likely_human", "uncertain", "words", "estimate", "estimate_low",
        "estimate_high", F.when(F.col("scored") > 0, percent(F.col("word_share"))).alias("word_percent"), third(F.col("mean")).alias("mean_p"), F.lit(0.58).alias("ai_from"), F.lit(0.42).alias("human_to"),
        F.lit(0.50).alias("widest"), "bins", "bins_with_mean", F.col("first.year").alias("first_year"), F.col("last.year").alias("last_year"), F.col("last.percent").alias("last_percent"),
        F.col("last.documents").alias("last_documents"), (-F.col("peak.y")).alias("peak_year"), F.col("peak.percent").alias("peak_percent"), "nodes", "edges",
    )


def era_articles(docs: DataFrame) -> DataFrame:
    """Cohort rows: id, title, year and date (null without), the column that the date is from, p_ai in thousandths, band."""
    dated = lambda c: year_of_date(F.coalesce(c, F.lit(""))) > 0
    origin = F.when(dated("created_at"), "createdAt").when(dated("published_at"), "publishedAt").otherwise("")
    return docs.select("id", "title", F.when(F.col("year") > 0, F.col("year")).alias("year"), F.nullif("date", F.lit("")).alias("date"), origin.alias("date_source"), third(F.col("p_ai")).alias("p_ai"), "band")


def different_topics(docs: DataFrame) -> DataFrame:
    """Country topics, each once whatever its case, as the document of least id has it."""
    rows = docs.where(is_country(F.col("topic"))).withColumn("topic", shown(trimmed(F.col("topic"))))
    return rows.groupBy(ascii_lower(F.col("topic")).alias("_k")).agg(F.min_by("topic", "id").alias("topic")).select("topic")


def different_titles(docs: DataFrame) -> DataFrame:
    """(id, title): of titles that agree but for case, the document of least id."""
    return docs.groupBy(ascii_lower(F.col("title")).alias("_k")).agg(F.min_by(F.struct("id", "title"), "id").alias("r")).select("r.*")


def longest_extract(docs: DataFrame, by: str) -> DataFrame:
    """The row of the longest text of each ``by``, the least id of equals."""
    order = F.struct(F.octet_length("text").alias("n"), (-F.col("id")).alias("i"))
    return docs.groupBy(by).agg(F.max_by("id", order).alias("id"))


def capped(docs: DataFrame, cap: int, germany: int = 1000) -> DataFrame:
    """The first ``cap`` documents by id of each topic (``germany`` at most of Germany's)."""
    most = F.when(ascii_lower(F.col("topic")) == "germany", F.lit(min(cap, germany))).otherwise(F.lit(cap))
    place = F.row_number().over(Window.partitionBy("topic").orderBy("id"))
    return docs.withColumn("_r", place).where(F.col("_r") <= cap).where(F.col("_r") <= most).drop("_r")


def topic_years(docs: DataFrame) -> DataFrame:
    """topic, documents, dated, first and last year of creation, from created_at or else published_at: the operations report."""
    year = F.substring(F.coalesce(F.nullif("created_at", F.lit("")), "published_at"), 1, 4).try_cast("int")
    return docs.groupBy("dataset_id", "topic").agg(F.count("*").alias("documents"), F.count(year).alias("dated"), F.min(year).alias("first"), F.max(year).alias("last"))
