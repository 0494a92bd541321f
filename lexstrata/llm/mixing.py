"""Mixing to target weights: posteriors from labels, then nonnegative document rates.

The rates come from a distributed projected gradient on the squares of the domains' gaps.
Native: DataFrame functions only; the driver sees 14 numbers per step.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import digest_of, fresh, keys_for_join, word_array
from .storage import materialize, shared_dir

#: Domains of the labels table: quality and toxic of a labelled document.
DOMAINS = ("plain", "toxic", "low", "low_toxic")
TARGETS = {"plain": 0.85, "toxic": 0.03, "low": 0.10, "low_toxic": 0.02}
BUCKETS = 1 << 15
#: Words of the whole labelled text's mixture that each domain has beforehand, so that rare words say little.
PRIOR = 20_000
#: Weight of the log ratios: their sum over the root of the words, so that long texts don't all become certain.
SHARPNESS = 3.0
#: Greatest gap of a domain's share to its target at which the fit ends; least part of a step that is tried; weight
#: that keeps a step's 4 x 4 system solvable.
TOLERANCE, LEAST_STEP, RIDGE = 1e-4, 1e-3, 1e-9
#: Steps after which the rates so far are written out, so that their expression stays short.
WRITE_OUT = 12
SCALE = 1_000_000


def _domain() -> F.Column:
    q, t = F.col("quality"), F.col("toxic")
    return F.when(q == 1, F.when(t == 1, 1).otherwise(0)).when(q == 0, F.when(t == 1, 3).otherwise(2))


def _named(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): of several labels of one document the least domain counts; null labels don't."""
    named = labels.select("doc_id", _domain().alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    return keys_for_join(named.groupBy("doc_id").agg(F.min("domain").alias("domain")))


def log_priors(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log of the share of each domain among labelled documents, over that of domain 0; one is added to each count."""
    n = docs.select("doc_id").join(_named(labels), "doc_id").agg(*(F.count_if(F.col("domain") == k) for k in range(4))).first()
    return [math.log((x + 1) / (n[0] + 1)) for x in n]


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, w1, w2, w3): log likelihood ratios to domain 0, in whole millionths; ``buckets`` rows at most.

    Multinomial naive Bayes over hashed words of all labelled documents, each domain shrunk towards all of them by
    ``PRIOR`` words.
    """
    counts = (
        docs.select("doc_id", "text").join(_named(labels), "doc_id").select("domain", F.explode(word_array(F.col("text"))).alias("_w"))
        .select("domain", F.xxhash64("_w").bitwiseAND(F.lit(buckets - 1)).alias("bucket"))
        .groupBy("bucket")
        .agg(*(F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(4)))
    )
    sums = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"s{k}") for k in range(4)))
    every, own = sum((F.col(f"s{k}") for k in range(1, 4)), F.col("s0")), sum((F.col(f"c{k}") for k in range(1, 4)), F.col("c0"))
    log_p = [F.log((F.col(f"c{k}") + PRIOR * (own + 1) / (every + buckets)) / (F.col(f"s{k}") + PRIOR)) for k in range(4)]
    ratios = [F.round((log_p[k] - log_p[0]) * SCALE).cast("long").alias(f"w{k}") for k in (1, 2, 3)]
    return counts.join(F.broadcast(sums), F.lit(True)).select("bucket", *ratios)


def posteriors(
    docs: DataFrame, weights: DataFrame, priors: list[float], buckets: int = BUCKETS, sharpness: float = SHARPNESS, carried: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The carried columns, n_words and p0..p3 of every row; a text without words gets the priors.

    Soft membership: the sum of the log ratios over the root of the number of words, times ``sharpness``, plus
    the log prior ratio.
    """
    token = F.when(F.col("_w").isNotNull(), F.xxhash64("_w").bitwiseAND(F.lit(buckets - 1)))
    sums = (
        docs.select(*carried, "text", F.monotonically_increasing_id().alias("_row")).select(*carried, "_row", F.explode_outer(word_array(F.col("text"))).alias("_w"))
        .select(*carried, "_row", token.alias("bucket"))
        .join(F.broadcast(weights), "bucket", "left")
        .groupBy("_row", *carried)
        .agg(F.count("bucket").alias("n_words"), *(F.coalesce(F.sum(f"w{k}"), F.lit(0)).alias(f"w{k}") for k in (1, 2, 3)))
    )
    n = F.greatest("n_words", F.lit(1))
    parts = [F.lit(1.0), *(F.exp(F.least(F.lit(60.0), F.col(f"w{k}") / SCALE / F.sqrt(n) * sharpness + priors[k])) for k in (1, 2, 3))]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return sums.select(*carried, "n_words", *((p / total).alias(f"p{k}") for k, p in enumerate(parts)))


def _wanted(targets: dict[str, float], shares: np.ndarray) -> np.ndarray:
    """The targets as shares of 1; domains without one share what is left in proportion to ``shares``."""
    if not targets or not set(targets) <= set(DOMAINS) or min(targets.values()) < 0:
        raise ValueError("targets must be nonnegative weights of known domains")
    named, total = np.array([d in targets for d in DOMAINS]), sum(targets.values())
    want = np.array([targets.get(d, 0.0) for d in DOMAINS], dtype=float)
    if named.all():
        if not total:
            raise ValueError("targets must not all be 0")
        return want / total
    if total > 1:
        raise ValueError("targets of some domains must not exceed 1")
    rest = shares[~named].sum()
    want[~named] = (1 - total) * (shares[~named] / rest if rest else 1 / (~named).sum())
    return want


def fit_rates(members: DataFrame, targets: dict[str, float], folder: str, steps: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with column rate >= 0, from 1 on: by words, the expected domain shares are ``targets``.

    Projected gradient on the squared gaps of the four shares, scaled by their curvature over the rows whose
    rate isn't 0: rate <- max(0, rate - p . move), where move solves curvature * move = gaps. A step is one
    aggregate over all members that sends 14 sums to the driver; it is halved until it lowers the squares.
    Steps go on until every share is within ``tolerance`` of its target; a fit that ends otherwise (no step helps,
    or ``steps`` are taken) warns with its gaps.
    """
    total = members.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    pairs = [(j, k) for j in range(4) for k in range(j, 4)]
    n = F.col("n_words") / total

    def sums(rate: F.Column, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the domains, and their curvature over the rows of rate above 0."""
        on = rows.withColumn("_r", rate).where("_r > 0")
        found = on.agg(*(F.sum(n * F.col("_r") * F.col(f"p{k}")) for k in range(4)), *(F.sum(n * F.col(f"p{j}") * F.col(f"p{k}")) for j, k in pairs)).first()
        found = np.array([x or 0.0 for x in found])
        curve = RIDGE * np.eye(4)
        for (j, k), x in zip(pairs, found[4:]):
            curve[j, k] += x
            curve[k, j] += x * (j != k)
        return found[:4], curve

    rate, taken = F.lit(1.0), 0
    shares, curve = sums(rate, members)
    want = _wanted(targets, shares)
    gap = shares - want
    while np.abs(gap).max() >= tolerance and taken != steps:
        move, size, better = np.linalg.solve(curve, gap), 1.0, None
        while better is None and size >= LEAST_STEP:
            pull = sum((F.col(f"p{k}") * float(size * x) for k, x in enumerate(move)), F.lit(0.0))
            after = F.greatest(F.lit(0.0), rate - pull)
            shares, then = sums(after, members)
            if np.linalg.norm(shares - want) <= (1 - 1e-4 * size) * np.linalg.norm(gap):
                better = after
            size /= 2
        if better is None:
            break
        rate, gap, curve, taken = better, shares - want, then, taken + 1
        if taken % WRITE_OUT == 0:
            members = materialize(members.drop("rate").withColumn("rate", rate), f"rates_{taken}", folder)
            rate = F.col("rate")
    if np.abs(gap).max() >= tolerance:
        warnings.warn(f"mixing ends after {taken} steps with gaps to its targets: {dict(zip(DOMAINS, gap.tolist()))}", stacklevel=2)
    return members.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] = TARGETS, steps: int | None = None) -> DataFrame:
    """doc_id, n_words, posteriors p_<domain>, rate: the expected uses of the document in the mixture.

    The sum of n_words * rate * p_<domain> over all rows is the domain's target share of all
    words, as far as nonnegative rates reach it; domains without a target keep their proportions. Null texts have no words, the priors as posteriors and
    so a rate; without labels all posteriors are equal; repeated rows each get a rate;
    an empty table gives no rows.
    """
    return _rated(docs.select("doc_id", "text"), labels, ("doc_id",), targets, steps)


def _rated(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...], targets: dict[str, float], steps: int | None) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    members = materialize(posteriors(docs, train(docs, labels), log_priors(docs, labels), carried=carried), "members", folder)
    return fit_rates(members, targets, folder, steps).select(
        *carried, "n_words", *(F.round(f"p{k}", 9).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate")
    )


def with_rates(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] = TARGETS, steps: int | None = None) -> DataFrame:
    """``docs`` with mix_rate, the expected uses of a row; rows of rate 0 go. A rate is one of the text, met by its digest.

    An input column mix_rate is replaced.
    """
    key = fresh(docs, "_digest")
    keyed = docs.drop("mix_rate").withColumn(key, digest_of(F.col("text")))
    rates = _rated(keyed.select("doc_id", "text", F.col(key).alias("digest")), labels, ("digest",), targets, steps)
    rates = rates.groupBy(F.col("digest").alias(key)).agg(F.min("rate").alias("mix_rate"))
    return keyed.join(rates, key).where("mix_rate > 0").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, labels)
