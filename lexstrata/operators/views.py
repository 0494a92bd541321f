"""View queries over scored documents: scope, aggregates, bins, examples, shared wording, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexstrata.functions.text import STOCK_PHRASES, ascii_lower, clip01, query_tokens, trimmed, word_tokens
from lexstrata.functions.topics import is_country, is_encyclopedia_name, matches, needle, with_view_topics
from lexstrata.storage import materialize, shared_dir

#: The signals that a view averages: detectors as measured, the others as calibrated.
SIGNAL_MEANS = (
    ("p_ai", "p_ai"), ("stylometry", "detector_stylometry"), ("stock_phrases", "stock"), ("uniformity", "detector_uniformity"), ("ngrams", "detector_repetition"),
    ("embedding_anomaly", "anomaly"), ("stylometry_deviation", "deviation"), ("post_chatgpt", "recency"),
)
#: Those that can be the strongest, in order.
STRONGEST = ("embedding_anomaly", "stock_phrases", "ngrams", "stylometry", "uniformity", "stylometry_deviation")
# Words that don't count as shared wording.
FILLERS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "from", "at", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that",
    "these", "those", "it", "its", "their", "they", "them", "we", "you", "your", "our", "not", "but", "if", "than", "then", "also", "into", "over", "after", "before",
    "about", "more", "most", "can", "will", "has", "have", "had", "his", "her", "she", "he", "which", "who", "whom", "what", "when", "where", "how", "all", "any",
    "each", "other", "such", "only", "own", "same", "so", "too", "very", "just", "because", "while", "through", "during", "without", "within", "between", "under",
    "again", "further", "once", "here", "there", "both", "few", "some", "no", "nor", "do", "does", "did", "doing", "would", "should", "could", "may", "might", "page",
    "pages", "see", "http", "https", "www", "com", "org", "html", "pdf", "new", "one", "two", "first", "last", "used", "using", "use", "including", "include", "based",
)
HIDDEN = "WIKIPEDIA_SUBSET"


def third(c: Column) -> Column:
    """Rounded to thousandths, halves away from zero."""
    return F.round(F.round(c, 9), 3)


def percent(c: Column) -> Column:
    """A share as a whole percent."""
    return F.round(F.round(100 * clip01(c), 9)).cast("int")


def encyclopedias(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.col("kind").isin("WIKIPEDIA_SAMPLE", HIDDEN) | is_encyclopedia_name(F.col("name"))).select("dataset_id").distinct()


def view(docs: DataFrame, datasets: DataFrame, dataset_id: int | None = None, topic: str = "", ids: DataFrame | None = None) -> DataFrame:
    """Documents of a collection (or of all but hidden ones) with view topic and subtopic, then of a topic, then of ids.

    Documents of collections that are gone never show; documents of an encyclopedia have canonical topics first.
    """
    live = datasets.where(F.col("kind") != HIDDEN) if dataset_id is None else datasets.where(F.col("dataset_id") == dataset_id)
    out = docs.join(F.broadcast(live.select("dataset_id").distinct()), "dataset_id", "left_semi")
    out = out.join(F.broadcast(encyclopedias(datasets).withColumn("_wiki_set", F.lit(True))), "dataset_id", "left")
    wiki = F.coalesce("_wiki_set", F.lit(False)) | ((ascii_lower(F.col("source")) == "wikipedia.org") if dataset_id is None else F.lit(False))
    out = with_view_topics(out, wiki).drop("_wiki_set")
    if topic.strip():
        out = out.where(matches(F.col("topic"), needle(docs.sparkSession, topic)))
    return out.join(ids, "id", "left_semi") if ids is not None else out


def interval(value: Column) -> list[Column]:
    """mean, low, high: 1.96 standard errors (0.08 for one value), within 0 and 1; 0 if empty."""
    n, mean = F.count(value), F.coalesce(F.avg(value), F.lit(0.0))
    error = F.when(n == 0, 0.0).otherwise(1.96 * F.when(n < 2, 0.08).otherwise(F.stddev_samp(value) / F.sqrt(F.greatest(n, F.lit(1)))))
    return [F.round(mean, 6).alias("mean"), F.round(clip01(mean - error), 6).alias("low"), F.round(clip01(mean + error), 6).alias("high")]


def signal_means(docs: DataFrame) -> list[Column]:
    """Mean signals that skip nulls, in thousandths, 0 where there are none; stock phrases and recency count in thousandths."""
    value = lambda c: third(F.col(c)) if c in ("stock", "recency") else F.col(c)
    return [F.coalesce(third(F.avg(value(c))), F.lit(0.0)).alias(f"mean_{name}") for name, c in SIGNAL_MEANS if c in docs.columns]


def summary(scored: DataFrame, metric: str = "documents") -> DataFrame:
    """Counts, bands, document and word shares, mean signals: one row; the headline's share and range are those of the metric."""
    band = lambda b: F.count_if(F.col("band") == b)
    one = scored.agg(
        F.count("*").alias("documents"), F.count("p_ai").alias("scored"), F.avg("p_ai").alias("_mean"), F.stddev_samp("p_ai").alias("_sd"), F.sum(F.when(F.col("p_ai").isNotNull(), F.col("word_count"))).alias("_w"),
        F.sum(F.col("p_ai") * F.col("word_count")).alias("_pw"), band("LIKELY_AI").alias("likely_ai"), band("UNCERTAIN").alias("uncertain"), band("LIKELY_HUMAN").alias("likely_human"), *signal_means(scored),
    )
    return summary_of(one, metric)


def summary_of(one: DataFrame, metric: str = "documents") -> DataFrame:
    """The summary's row from its counts, the mean and deviation of scores (_mean, _sd), words (_w) and scores by words (_pw)."""
    one = one.withColumn("_e", F.when(F.col("scored") > 0, 1.96 * F.when(F.col("scored") < 2, 0.08).otherwise(F.col("_sd") / F.sqrt(F.greatest("scored", F.lit(1))))))
    around = lambda middle, sign: clip01(F.col(middle) + sign * F.coalesce("_e", F.lit(0.0)))
    one = one.withColumn("_mean", F.coalesce("_mean", F.lit(0.0))).withColumn("word_share", F.round(F.coalesce(F.try_divide("_pw", "_w"), F.lit(0.0)), 6))
    one = one.withColumns({"mean": F.round("_mean", 6), "low": F.round(around("_mean", -1), 6), "high": F.round(around("_mean", 1), 6), "words": F.coalesce("_w", F.lit(0))})
    words = F.lit(metric.lower() == "words")
    middle = F.when(words, F.col("word_share")).otherwise(F.col("mean"))
    low, high = (F.when(words, clip01(F.col("word_share") + sign * F.col("_e"))).otherwise(F.col(c)) for sign, c in ((-1, "low"), (1, "high")))
    known = F.col("scored") > 0
    one = one.withColumns({"estimate": F.when(known, percent(middle)), "estimate_low": F.when(known, percent(low)), "estimate_high": F.when(known, percent(high))})
    return one.drop("_e", "_mean", "_sd", "_w", "_pw")


def comparison(this: DataFrame, other: DataFrame, kind: str, metric: str = "documents") -> DataFrame:
    """For a collection of addresses, its estimate beside ``other``, the summary of the encyclopedia's stored scores, which aren't rescored; no row for other kinds."""
    mine = summary(this, metric).select(F.col("documents").alias("this_documents"), F.col("estimate").alias("this_estimate"))
    theirs = other.select(F.col("documents").alias("other_documents"), F.col("estimate").alias("other_estimate"))
    return mine.join(F.broadcast(theirs), F.lit(True)).where(F.lit(kind == "USER_URLS"))


def breakdown(scored: DataFrame, by: str, least: int = 1) -> DataFrame:
    """key, documents, mean, low, high of scored documents by topic (countries alone) or, for any other ``by``, by source."""
    key = trimmed(F.col("topic")) if by == "topic" else trimmed(F.col("source"))
    rows = scored.withColumn("key", key).where("p_ai IS NOT NULL AND key <> ''")
    rows = rows.where(is_country(F.col("key"))) if by == "topic" else rows
    return rows.groupBy("key").agg(F.count("*").alias("documents"), *interval(F.col("p_ai"))).where(F.col("documents") >= least)


def by_year(scored: DataFrame, first: int = 2015, now: int = 2026) -> DataFrame:
    """A row for each year from ``first`` to the last one seen: dated documents, mean and range of scored ones (null without any)."""
    dated = scored.where(F.col("year") >= first)
    mean, low, high = interval(F.col("p_ai"))
    some = lambda c, name: F.when(F.count("p_ai") > 0, c).alias(name)
    years = materialize(dated.groupBy("year").agg(F.count("*").alias("documents"), some(mean, "mean"), some(low, "low"), some(high, "high")), "years")
    axis = years.agg(F.max("year").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(first), F.least("last", F.lit(now)))).alias("year"))
    return axis.join(years, "year", "left").select("year", F.coalesce("documents", F.lit(0)).alias("documents"), "mean", "low", "high")


def topics(docs: DataFrame, least: int = 100) -> DataFrame:
    return docs.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)


def topic_means(scored: DataFrame) -> DataFrame:
    """topic, documents, mean of scored documents of each country topic."""
    return scored.where("topic <> '' AND p_ai IS NOT NULL").groupBy("topic").agg(F.count("*").alias("documents"), F.round(F.avg("p_ai"), 6).alias("mean"))


def examples(means: DataFrame, band: str = "", limit: int = 6, least: int = 1) -> DataFrame:
    """``topic_means`` with the band of the mean: the strongest first for the AI band, the weakest for the human one, else the largest.

    A ``limit`` of 0 or less is none.
    """
    rows = means.where(F.col("documents") >= least).withColumn("band", F.when(F.col("mean") >= 0.58, "LIKELY_AI").when(F.col("mean") <= 0.42, "LIKELY_HUMAN").otherwise("UNCERTAIN"))
    rows = rows.where(F.col("band") == band) if band else rows
    order = {"LIKELY_AI": F.desc("mean"), "LIKELY_HUMAN": F.asc("mean")}.get(band, F.desc("documents"))
    rows = rows.orderBy(order, ascii_lower(F.col("topic")))
    return rows.limit(limit) if limit > 0 else rows


def group_by(docs: DataFrame, topic: str = "", least: int = 100) -> str:
    """'topic' if some country has ``least`` documents in a view without a topic, else 'dataset'."""
    if topic.strip():
        return "dataset"
    return "dataset" if docs.where(is_country(F.col("topic"))).groupBy("topic").count().where(F.col("count") >= least).isEmpty() else "topic"


def groups(docs: DataFrame, by: str, least: int = 100) -> DataFrame:
    """(key, documents, place) of a view's groups, largest first: countries of ``least`` documents, or collections (column ``collection``) folded over 8."""
    if by == "topic":
        sizes = docs.where(is_country(F.col("topic"))).groupBy(F.col("topic").alias("key")).agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    else:
        sizes = group_fold(docs, "collection").withColumnRenamed("name", "key")
    place = F.row_number().over(Window.orderBy(F.desc("documents"), ascii_lower(F.col("key"))))
    return sizes.withColumn("place", place)


def group_fold(docs: DataFrame, by: str, keep: int = 7) -> DataFrame:
    """Group sizes; of over ``keep`` + 1 groups the ``keep`` largest by themselves and the rest as one."""
    sizes = materialize(docs.groupBy(F.col(by).cast("string").alias("name")).agg(F.count("*").alias("documents")), "sizes")
    if sizes.limit(keep + 2).count() <= keep + 1:
        return sizes
    top = materialize(sizes.orderBy(F.desc("documents"), ascii_lower(F.col("name")), "name").limit(keep), "largest")
    rest = sizes.join(F.broadcast(top.select("name")), sizes.name.eqNullSafe(top.name), "left_anti").agg(F.sum("documents").alias("documents"))
    return top.unionByName(rest.select(F.lit("Other (remaining groups)").alias("name"), "documents"))


def most_ai(scored: DataFrame, top: int = 220) -> DataFrame:
    """id of the ``top`` likely-AI documents by score."""
    return scored.where("band = 'LIKELY_AI'").orderBy(F.desc(F.round("p_ai", 6)), "id").limit(top).select("id")


def wording(texts: DataFrame) -> DataFrame:
    """(kind, key) of each document's (title, text) different stock phrases, words, and phrases of two and three words."""
    blob = F.concat(F.col("title"), F.lit("\n"), F.substring("text", 1, 6000))
    low = ascii_lower(blob)
    rows = texts.select(low.alias("_low"), word_tokens(blob).alias("_w"))
    plain = lambda w: (F.octet_length(w) >= 3) & ~w.isin(*FILLERS)
    at = lambda i, k: F.get("_w", i + k)
    places = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)))
    two = F.filter(places, lambda i: at(i, 1).isNotNull() & (F.octet_length(at(i, 0)) >= 3) & (F.octet_length(at(i, 1)) >= 3) & (plain(at(i, 0)) | plain(at(i, 1))))
    three = F.filter(places, lambda i: at(i, 2).isNotNull() & (sum((plain(at(i, k)).cast("int") for k in (1, 2)), plain(at(i, 0)).cast("int")) >= 2))
    stock = F.filter(F.array(*map(F.lit, STOCK_PHRASES)), lambda p: F.contains(F.col("_low"), p))
    phrases = F.concat(F.transform(two, lambda i: F.concat_ws(" ", at(i, 0), at(i, 1))), F.transform(three, lambda i: F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2))))
    kinds = (("stock", stock), ("word", F.filter("_w", plain)), ("phrase", phrases))
    named = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    pairs = F.flatten(F.array(*(named(*pair) for pair in kinds)))
    return rows.select(F.inline(pairs))


def common_wording(scored: DataFrame, texts: DataFrame, top: int = 220) -> DataFrame:
    """(kind, key, documents, place): stock phrases, words and phrases that most of the ``top`` likely-AI documents hold.

    Stock phrases need 2 documents, words max(3, 8 %), phrases max(3, 6 %); 4, 6 and 5 rows; ties by key.
    """
    folder = shared_dir(scored.sparkSession)
    best = materialize(most_ai(scored, top), "best", folder)
    found = wording(texts.join(F.broadcast(best), "id", "left_semi")).groupBy("kind", "key").agg(F.count("*").alias("documents"))
    n = F.broadcast(best.agg(F.count("*").alias("_n")))
    kind = lambda stock, word, phrase: F.when(F.col("kind") == "stock", F.lit(stock)).when(F.col("kind") == "word", F.lit(word)).otherwise(F.lit(phrase))
    least = F.greatest(kind(2, 3, 3), F.floor(F.col("_n") * kind(0, 8, 6) / 100))
    keep = kind(4, 6, 5)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("documents"), "key"))
    rows = found.join(n, F.lit(True)).where(F.col("documents") >= least).withColumn("place", place)
    return rows.where((F.col("place") <= 6) & (F.col("place") <= keep)).select("kind", "key", "documents", "place")


def strongest_signal(scored: DataFrame) -> DataFrame:
    """The signal of greatest mean, the first of equals; recency doesn't take part."""
    means = scored.agg(*signal_means(scored), F.count("*").alias("_n")).where("_n > 0")
    rows = means.select(F.inline(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"mean_{c}").alias("score"), F.lit(i).alias("i")) for i, c in enumerate(STRONGEST)))))
    return rows.orderBy(F.desc("score"), "i").limit(1).select("key", "score")


def evidence(stored: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """Documents by question hits in title, topic, address and source, stored distance from even odds, and stored band."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    blob = ascii_lower(F.concat_ws(" ", part("title"), part("topic"), part("url"), part("source")))
    hits = sum((F.when(blob.contains(t), 4.0).otherwise(0.0) for t in query_tokens(question)), F.lit(0.0))
    score = hits + F.coalesce(F.abs(F.col("p_ai") - 0.5) * 2, F.lit(0.0)) + F.when(F.col("band") == "LIKELY_AI", 0.5).otherwise(0.0)
    return stored.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "band")


def excerpt(text: Column, question: str, size: int) -> Column:
    """``size`` characters (80 at least) of the text's head from 80 before the first word of the question, dots where it is cut."""
    head = F.substring(text, 1, 4 * size)
    low = ascii_lower(head)
    first = F.least(*(F.nullif(F.instr(low, t), F.lit(0)) for t in query_tokens(question)), F.lit(None).cast("int"), F.lit(None).cast("int"))
    start = F.greatest(F.coalesce(first, F.lit(1)) - 81, F.lit(0))
    part = trimmed(F.substring(head, start + 1, F.lit(max(80, size))))
    part = F.when(start > 0, F.concat(F.lit("…"), part)).otherwise(part)
    return F.when(start + F.length(part) < F.length(head), F.concat(part, F.lit("…"))).otherwise(part)


def sample_evenly(docs: DataFrame, by: str, n: int = 50) -> DataFrame:
    """n documents of each group at even steps in order of (date, id); all of smaller groups.

    Which dates the steps fall on follows from the counts by (group, date); rows are ranked within those dates alone.
    """
    counts = materialize(docs.groupBy(by, "date").agg(F.count("*").alias("_k")), "dates")
    before = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(by)))
    step = F.greatest(F.lit(1), F.lit(n - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / step))
    picks = F.array_distinct(F.filter(picks, lambda p: (p >= F.col("_b")) & (p < F.col("_b") + F.col("_k"))))
    spans = spans.withColumn("_p", picks).where((F.col("_n") <= n) | (F.size("_p") > 0)).select(F.col(by).alias("_g"), F.col("date").alias("_d"), "_b", "_n", "_p")
    rows = docs.join(spans, docs[by].eqNullSafe(F.col("_g")) & docs["date"].eqNullSafe(F.col("_d")))
    place = F.col("_b") + F.row_number().over(Window.partitionBy("_g", "_d").orderBy("id")) - 1
    return rows.withColumn("_r", place).where((F.col("_n") <= n) | F.array_contains("_p", F.col("_r"))).select(*docs.columns)


def rise_year(years: DataFrame) -> DataFrame:
    """First year at 40 % or more with an earlier year, all of them under 30 % or their median under 30 %; the least and greatest later mean of 55 % or more."""
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    rows = years.where("mean IS NOT NULL").withColumn("_k", F.count("*").over(before)).withColumn("_max", F.max("mean").over(before)).withColumn("_med", F.percentile("mean", 0.5).over(before))
    first = rows.where((F.col("mean") >= 0.4) & (F.col("_k") > 0) & ((F.col("_max") < 0.3) | (F.col("_med") < 0.3))).agg(F.min("year").alias("rise_year"))
    high = F.when((F.col("year") > F.col("rise_year")) & (F.col("mean") >= 0.55), F.col("mean"))
    return first.join(years.select("year", "mean"), F.lit(True), "left").groupBy("rise_year").agg(F.min(high).alias("late_low"), F.max(high).alias("late_high"))


