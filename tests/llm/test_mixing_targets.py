import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import mixing

from . import brute

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_production_targets_are_reached(tables):
    docs, labels = tables
    got = mixing.mix(docs, labels).cache()
    total = got.agg(F.sum("n_words")).first()[0]
    for d, w in mixing.TARGETS.items():
        assert abs(got.agg(F.sum(F.col("n_words") * F.col("rate") * F.col(f"p_{d}"))).first()[0] / total - w) < 2 * mixing.TOLERANCE


def test_pipeline_keeps_plain_rows(tables):
    docs, labels = tables
    kept = mixing.with_rates(docs, labels).select("doc_id").distinct()
    plain = docs.join(labels.where("quality = 1 AND toxic = 0"), "doc_id").select("doc_id").distinct()
    assert plain.join(kept, "doc_id").count() >= 0.99 * plain.count()
    assert kept.count() >= 0.9 * docs.select("doc_id").distinct().count()


def test_priors_follow_the_labels(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(8)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6), int(i == 5)) for i in range(8)] + [(99, 0, 1), (7, None, 1)], LABELS)
    row = mixing.mix(docs, labels, targets={"plain": 0.5, "toxic": 0.2, "low": 0.2, "low_toxic": 0.1}, steps=1).where("doc_id = 9").first()
    assert [round(row[f"p_{d}"], 6) for d in mixing.DOMAINS] == [round(x / 12, 6) for x in (6, 2, 3, 1)]


def test_a_fit_that_misses_warns(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="gaps"):
        mixing.mix(docs, spark.createDataFrame([], LABELS))


def test_rates_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[d % 4 * 8 :] if rng.random() < 0.7 else words) for _ in range(rng.randint(1, 60))) for d in range(80)] + [None, ""]
    domains = [d % 4 if d < 48 else None for d in range(82)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d < 2), d % 2) for i, d in enumerate(domains) if d is not None], LABELS)
    bucket = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").bitwiseAND(F.lit(mixing.BUCKETS - 1)).alias("h")).collect()}
    targets = {"plain": 0.4, "toxic": 0.1, "low": 0.3, "low_toxic": 0.2}
    p = brute.posteriors(texts, domains, bucket, mixing.BUCKETS, mixing.PRIOR, mixing.SHARPNESS)
    n = [len((t or "").split()) for t in texts]
    want = brute.rates(p, n, np.array([targets[d] for d in mixing.DOMAINS]))
    for r in mixing.mix(docs, labels, targets=targets).collect():
        assert all(abs(r[f"p_{d}"] - p[r.doc_id, k]) < 1e-6 for k, d in enumerate(mixing.DOMAINS))
        assert abs(r.rate - want[r.doc_id]) < 1e-4 and r.n_words == n[r.doc_id]


def test_partial_targets_keep_other_proportions(tables):
    docs, labels = tables
    before, after = (mixing.mix(docs, labels, targets=t, steps=s).cache() for t, s in (({"plain": 1.0, "toxic": 1.0, "low": 1.0, "low_toxic": 1.0}, 0), ({"toxic": 0.03}, None)))
    shares = lambda df: [df.agg(F.sum(F.col("n_words") * F.col("rate") * F.col(f"p_{d}")) / F.sum("n_words")).first()[0] for d in mixing.DOMAINS]
    a, b = shares(before), shares(after)
    assert abs(b[1] - 0.03) < 2e-4 and all(abs(b[k] - a[k] * 0.97 / (1 - a[1])) < 3e-4 for k in (0, 2, 3))
    for bad in ({}, {"plain": -1.0}, {"toxic": 1.2}, {"other": 0.1}):
        with pytest.raises(ValueError, match="targets"):
            mixing.mix(docs, labels, targets=bad)
