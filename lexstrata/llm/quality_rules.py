"""Quality rules: fixed repetition rules, then a hashed n-gram likelihood ratio.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import digest_of, feature_rows, fresh, keys_for_join, word_array
from .storage import materialize

BUCKETS = 1 << 16
#: Log ratios are kept as whole millionths, so that sums don't depend on order.
SCALE = 1_000_000
THRESHOLD = -0.1
#: Occurrences that every bucket has beforehand, in trusted text as in raw, so that rare n-grams say little.
PRIOR = 64


def base_features(docs: DataFrame) -> DataFrame:
    """Adds words and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and blank texts have no words and fail; repeated rows stay repeated.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumn("words", word_array(F.col("text"))).withColumn("_lines", lines)
    step = step.withColumn("n_words", F.size("words").cast("long"))
    step = step.withColumn(
        "_grams",
        F.expr(
            "CASE WHEN n_words < 4 THEN CAST(array() AS ARRAY<STRUCT<g: BIGINT, i: INT>>) ELSE "
            "sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), "
            "i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS g, i AS i))) END"
        ),
    )
    return step.select(
        *docs.columns,
        "words",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "transform(array(_grams), s -> size(array_distinct(flatten(transform(filter(s, (x, j) -> "
            "(j > 0 AND s[j - 1].g = x.g) OR (j + 1 < size(s) AND s[j + 1].g = x.g)), "
            "x -> array(x.i, x.i + 1, x.i + 2))))))[0]"
        )
        .cast("long")
        .alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight): log of trusted over raw probability, ``buckets`` rows at most.

    Every document counts; ``trusted`` holds doc_id. With no trusted document all weights are 0.
    """
    marked = docs.join(
        keys_for_join(trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_t", F.lit(1))), "doc_id", "left"
    )
    words = marked.select("_t", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    counts = (
        feature_rows(words, ["_t"], buckets).select("_t", F.expr("stack(2, uni, bi) AS bucket")).where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_t").alias("good"))
    )
    sums = counts.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"))
    share = F.col("good_all") / F.col("raw_all")
    ratio = F.log(F.col("good") + PRIOR * share) - F.log(share) - F.log(F.col("raw") + PRIOR)
    return counts.join(F.broadcast(sums), F.lit(True)).select(
        "bucket",
        F.when(F.col("good_all") > 0, F.round(ratio * SCALE)).otherwise(0).cast("long").alias("weight"),
    )


NAMED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _scored(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...], threshold: float, buckets: int) -> DataFrame:
    weights = ratio_weights(docs.select("doc_id", "text"), labels.where("quality = 1"), buckets)
    base = base_features(docs.select(*carried, "text")).withColumn("_row", F.monotonically_increasing_id())
    one, two = (weights.select(F.col("bucket").alias(k), F.col("weight").alias(f"_{k}")) for k in ("uni", "bi"))
    scored = (
        feature_rows(base, ["_row", *carried, *NAMED], buckets)
        .join(F.broadcast(one), "uni", "left")
        .join(F.broadcast(two), "bi", "left")
        .groupBy("_row", *carried, *NAMED)
        .agg(F.sum(F.coalesce("_uni", F.lit(0)) + F.coalesce("_bi", F.lit(0))).alias("_sum"))
    )
    llr = F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1) / SCALE)
    kept = ~F.col("base_failed") & (F.coalesce(llr, F.lit(float("-inf"))) >= threshold)
    return scored.select(*carried, *NAMED, llr.alias("llr"), kept.alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log ratio per n-gram; null without any) and kept.

    Trusted text: documents whose label has quality 1. ``THRESHOLD`` and ``PRIOR`` are fixed numbers, chosen on held-out
    labels of a corpus like this one; another corpus wants its own ``threshold``. A document is kept if the base
    rules pass and llr is at least ``threshold``. Null texts fail; null ids are judged like
    others; repeated rows are each judged; empty tables give no rows.
    """
    return _scored(docs, labels, ("doc_id",), threshold, buckets)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. The verdict is one of the text, so it is met by the text's digest."""
    key = fresh(docs, "_digest")
    keyed = docs.withColumn(key, digest_of(F.col("text")))
    bad = _scored(keyed.select("doc_id", "text", F.col(key).alias("digest")), labels, ("digest",), threshold, buckets).where("NOT kept")
    bad = materialize(bad.select(F.col("digest").alias(key)).distinct(), "rejected")
    return keyed.join(keys_for_join(bad), key, "left_anti").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels)
