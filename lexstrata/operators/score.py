"""Era calibration of a collection: baseline statistics, ranks, logistic blend, bands.

Features are computed once and stored without the texts; a scope is scored from one pass that
writes a narrow table (embeddings projected to their distance), on which statistics and
ranks are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexstrata.functions.embed import centroids, cosine, hashed_embedding
from lexstrata.functions.text import clip01, detectors, document_date, recency_signal, style_features, year_of_date
from lexstrata.storage import exists, materialize, shared_dir

AI_MIN, HUMAN_MAX, MAX_INTERVAL, RANK_MIX = 0.58, 0.42, 0.50, 0.38
SIGNALS = ("stylometry", "stock", "uniformity", "ngram", "anomaly", "deviation", "recency")
MEASURED = ("detector_stylometry", "stock_phrases", "detector_repetition", "detector_uniformity", "distance", "type_token_ratio", "burstiness")
#: What a stored score consists of.
STORED = ("p_ai", "ci_low", "ci_high", "band", *SIGNALS)


def featured(docs: DataFrame) -> DataFrame:
    """Documents with features, detectors, embedding, date and year."""
    step = detectors(style_features(docs)).withColumn("embedding", hashed_embedding(F.concat_ws("\n", "title", "text")))
    return step.withColumn("date", document_date()).withColumn("year", year_of_date(F.col("date")))


def add_features(docs: DataFrame, path: str) -> DataFrame:
    """The feature table at ``path`` after the rows of ``docs`` whose id it lacks are featured and appended; texts aren't stored."""
    spark = docs.sparkSession
    if exists(spark, path):
        docs = docs.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    featured(docs).drop("text").write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fractional_rank(df: DataFrame, by: list[str], value: str, name: str, folder: str | None = None) -> DataFrame:
    """Adds (ties averaged) rank / (n - 1); 0.5 alone; null values have null ranks and don't count. Values are compared at 9 places.

    The different values are sorted by range over all partitions; a partition's first rank follows from the
    counts before it, so that no scope is sorted in one task.
    """
    folder = folder or shared_dir(df.sparkSession)
    keyed = df.withColumn("_v", F.round(F.col(value), 9) + 0.0)
    counts = keyed.where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_k")).repartitionByRange(*by, "_v")
    counts = materialize(counts.withColumn("_p", F.spark_partition_id()), f"counts_{name}", folder)
    parts = counts.groupBy(*by, "_p").agg(F.sum("_k").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*by)).alias("_n"))
    inside = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(*by, "_p", "_v", "_k", F.coalesce(F.sum("_k").over(inside), F.lit(0)).alias("_i")).join(parts, [*by, "_p"])
    rank = F.when(F.col("_n") > 1, (F.col("_b") + F.col("_i") + (F.col("_k") - 1) / 2) / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.5)
    ranks = materialize(rows.select(*by, "_v", rank.alias(name)), f"ranks_{name}", folder)
    return keyed.join(ranks, [*by, "_v"], "left").drop("_v")


def _z(value: str) -> Column:
    sd = F.col(f"{value}_sd")
    return (F.col(value) - F.col(f"{value}_mean")) / F.when(F.col(f"{value}_n") < 2, 1.0).when(sd < 1e-6, 1.0).otherwise(sd)


def _excess(value: str) -> Column:
    return clip01(0.5 + 0.5 * F.tanh(_z(value) / 2))


def band_of(p: Column, interval: Column) -> Column:
    p, interval = F.round(p, 9), F.round(interval, 9)
    return F.when(interval > MAX_INTERVAL, "UNCERTAIN").when(p >= AI_MIN, "LIKELY_AI").when(p <= HUMAN_MAX, "LIKELY_HUMAN").otherwise("UNCERTAIN")


def forced_human(docs: DataFrame) -> DataFrame:
    """``docs`` with the fixed low score of earlier-dated documents in rows of ``pre``."""
    pre, human = F.col("pre"), clip01(0.025 + 0.04 * clip01(F.coalesce("detector_stylometry", F.lit(0.0))))
    docs = docs.withColumn("p_ai", F.when(pre, human).otherwise(F.col("p_ai")))
    forced = {"ci_low": clip01(F.col("p_ai") - 0.03), "ci_high": clip01(F.col("p_ai") + 0.08), "band": F.lit("LIKELY_HUMAN")}
    return docs.withColumns({c: F.when(pre, x).otherwise(F.col(c)) for c, x in forced.items()})


def _scopes(docs: DataFrame, by: str, folder: str) -> DataFrame:
    """by, n, have_pre: a scope has a baseline if an earlier-dated document of it has a vector."""
    vector = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return materialize(docs.groupBy(by).agg(F.count("*").alias("n"), F.max(F.col("pre") & vector).alias("have_pre")), "scopes", folder)


def _centres(docs: DataFrame, scopes: DataFrame, by: str, folder: str) -> DataFrame:
    """by, centroid: of the baseline; without one, of the max(2, min(8, n / 6)) documents of least stylometry, or else of all."""
    docs = docs.where("size(embedding) > 0")
    found = centroids(docs.where("pre").join(scopes.where("have_pre").select(by), by, "left_semi"), [by], "embedding")
    if not scopes.where("NOT have_pre").isEmpty():
        bare = docs.join(scopes.where("NOT have_pre").select(by, "n"), by)
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce("detector_stylometry", F.lit(0.0)), "id"))
        take = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.col("n") / 6)))
        least = bare.withColumn("_r", rank).where("_r <= 8").where(F.col("_r") <= take)
        found = found.unionByName(centroids(least, [by], "embedding"))
    return materialize(found, "centres", folder)


def with_raw(docs: DataFrame) -> DataFrame:
    """Adds the signals, raw_p (9 places) and the widths of its interval, from measures, their moments (_mean, _sd, _n) and anomaly_rank."""
    have = F.col("have_pre")
    far = F.when(have, _excess("distance")).otherwise(clip01(1.4 * F.col("distance")))
    pick = lambda v: F.when(have, _excess(v)).otherwise(clip01(F.col(v)))
    docs = docs.fillna(0.0, [v for v in MEASURED if v != "distance"]).withColumns({
        "anomaly": clip01(0.45 * far + 0.55 * F.col("anomaly_rank")), "stylometry": pick("detector_stylometry"), "stock": pick("stock_phrases"), "ngram": pick("detector_repetition"),
        "uniformity": pick("detector_uniformity"), "deviation": clip01((F.abs(_z("type_token_ratio")) + F.abs(_z("burstiness"))) / 6), "recency": F.when(F.col("pre"), 0.0).otherwise(recency_signal(F.col("date"))),
    })
    signal = lambda c, default: F.when(F.isnan(c), default).otherwise(F.col(c))
    z = (
        0.58 + 0.70 * (signal("stylometry", 0.5) - 0.5) + 1.10 * (signal("stock", 0.5) - 0.5) + 0.85 * (signal("uniformity", 0.5) - 0.5) + 0.28 * (signal("ngram", 0.5) - 0.5)
        + 0.50 * (signal("anomaly", 0.5) - 0.5) + 0.30 * (signal("deviation", 0.5) - 0.5) + 1.15 * (signal("recency", 0.45) - 0.45)
    )
    core = [signal(c, d) for c, d in (("stylometry", 0.5), ("uniformity", 0.5), ("recency", 0.45))]
    mean = (core[0] + core[1] + core[2]) / 3
    half = F.least(F.lit(0.22), 0.06 + 0.45 * F.sqrt(((core[0] - mean) ** 2 + (core[1] - mean) ** 2 + (core[2] - mean) ** 2) / 3))
    docs = docs.withColumns({"raw_p": F.round(1 / (1 + F.exp(-z)), 9), "_half": half})
    return docs.withColumn("_raw_width", clip01(F.col("raw_p") + F.col("_half")) - clip01(F.col("raw_p") - F.col("_half")))


def with_bands(docs: DataFrame) -> DataFrame:
    """p_ai, ci_low, ci_high and band from raw_p and its rank, earlier-dated documents forced low; without what was needed for them."""
    mixed = clip01((1 - RANK_MIX) * F.col("raw_p") + RANK_MIX * F.col("_rank"))
    wide = F.greatest(F.lit(0.05), F.col("_raw_width") / 2)
    docs = docs.withColumn("p_ai", mixed).withColumns({"ci_low": clip01(F.col("p_ai") - wide), "ci_high": clip01(F.col("p_ai") + wide)})
    docs = forced_human(docs.withColumn("band", band_of(F.col("p_ai"), F.col("ci_high") - F.col("ci_low"))))
    return docs.drop("_half", "_raw_width", "_rank", *(f"{v}_{k}" for v in MEASURED for k in ("mean", "sd", "n")))


def distanced(docs: DataFrame) -> DataFrame:
    """Rows with ``centroid`` get distance (9 places, 0.5 without a vector) and vector (whether there is one) instead of it and the embedding."""
    known = (F.size("embedding") > 0) & F.col("centroid").isNotNull()
    far = F.when(known, F.round(1 - cosine(F.col("embedding"), F.col("centroid")), 9)).otherwise(0.5)
    return docs.withColumns({"distance": far, "vector": F.coalesce(known, F.lit(False))}).drop("embedding", "centroid")


def moments(docs: DataFrame, by: str, names: tuple[str, ...] = MEASURED) -> DataFrame:
    """by, and mean, sd and n of each of ``names`` over the scope's baseline (all of its rows, if it has none)."""
    counted = F.col("pre") | ~F.col("have_pre")
    base = lambda v: F.when(counted & (F.col("vector") if v == "distance" else F.lit(True)), F.coalesce(v, F.lit(0.0)))
    return docs.groupBy(by).agg(*(x for v in names for x in (F.avg(base(v)).alias(f"{v}_mean"), F.stddev_samp(base(v)).alias(f"{v}_sd"), F.count(base(v)).alias(f"{v}_n"))))


def calibrated(docs: DataFrame, by: str, folder: str, stats: DataFrame | None = None) -> DataFrame:
    """``distanced`` rows (stored, with pre and have_pre) with signals, p_ai, ci_low, ci_high and band; ``stats`` are the scopes' moments, if known."""
    stats = materialize(moments(docs, by) if stats is None else stats, "stats", folder)
    docs = fractional_rank(docs.join(stats, by), [by], "distance", "anomaly_rank", folder)
    return with_bands(fractional_rank(with_raw(docs), [by, "pre"], "raw_p", "_rank", folder))


def era_scores(docs: DataFrame, by: str = "dataset_id", keep_stored: bool = False) -> DataFrame:
    """``featured`` documents (texts aren't needed) with signals, p_ai, ci_low, ci_high and band, calibrated within each ``by``.

    Baseline: documents dated before 2019. A scope without baseline is scored from raw signals around the
    centroid of its least formulaic documents or, with ``keep_stored`` (as views do), keeps the STORED columns of
    ``docs``, earlier-dated documents still forced low. Documents without a vector have distance 0.5. The
    embedding isn't carried on. An empty scope gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    docs = docs.withColumn("pre", F.coalesce((F.col("year") > 0) & (F.col("year") < 2019), F.lit(False)))
    scopes = _scopes(docs, by, folder)
    kept = None
    if keep_stored:
        bare = docs.join(scopes.where("NOT have_pre").select(by), by, "left_semi")
        kept = forced_human(bare).withColumn("have_pre", F.lit(False)).drop("embedding")
        docs = docs.join(scopes.where("have_pre").select(by), by, "left_semi")
    docs = docs.drop(*STORED)
    docs = docs.join(_centres(docs, scopes, by, folder), by, "left").join(scopes.select(by, "have_pre"), by)
    docs = materialize(distanced(docs), "distances", folder)
    docs = calibrated(docs, by, folder)
    return docs if kept is None else docs.unionByName(kept, allowMissingColumns=True)
