"""Views from mergeable statistics: a cube of cells, and scores of a view's rows from merged cells.

A cell is a collection, view topic, source and year. It holds counts, means and squared deviations of the
measures that calibration needs, the vector sum of its earlier-dated documents, and the same of stored scores. A view
merges the cells in its scope: that gives its baseline, and whole answers where stored scores are kept.
Scores that depend on the view's own baseline take one pass over the scope's rows, which writes one narrow
table; ranks come from exact histograms of the values, without a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexstrata.functions.embed import cosine
from lexstrata.functions.text import ascii_lower
from lexstrata.functions.topics import matches, needle, with_view_topics
from lexstrata.operators import score, views
from lexstrata.storage import materialize, shared_dir

KEYS = ("dataset_id", "topic", "source", "year")
#: Measures of the baseline whose moments don't depend on the view; that of the distance comes from its histogram.
BASE = tuple(m for m in score.MEASURED if m != "distance")
#: Bits of a value at 9 places that tell values of one bucket apart: a bucket has at most 2**18 different values.
BUCKET = 18


def rows_of(analysed: DataFrame) -> DataFrame:
    """``analysed`` documents as views read them: view topics, ``pre``, in order of collection and topic so that scans can skip files' parts."""
    rows = with_view_topics(analysed).withColumn("pre", F.coalesce((F.col("year") > 0) & (F.col("year") < 2019), F.lit(False)))
    return rows.repartitionByRange("dataset_id", "topic", "id").sortWithinPartitions("dataset_id", "topic")


def mergeable(value: Column, name: str) -> list[Column]:
    """count, mean and squared deviations, as mergeable columns."""
    n = F.count(value)
    return [n.alias(f"{name}_n"), F.avg(value).alias(f"{name}_mean"), F.when(n > 1, F.var_pop(value) * n).otherwise(0.0).alias(f"{name}_m2")]


def cells(rows: DataFrame) -> DataFrame:
    """The cells of ``rows_of`` rows: counts, moments of the baseline and of stored scores, and the baseline's vector sum."""
    docs = score.forced_human(rows).withColumns({f"_{c}": F.coalesce(F.col(c).cast("string") if c != "year" else F.col(c), F.lit(0) if c == "year" else F.lit("")) for c in ("source", "year")})
    docs = docs.withColumns({"source": F.col("_source"), "year": F.col("_year")}).drop("_source", "_year")
    pre = F.col("pre")
    known = F.col("p_ai").isNotNull()
    sums = [F.sum(c).alias(n) for n, c in _stored(docs)]
    counts = docs.groupBy(*KEYS).agg(
        F.count("*").alias("documents"), F.sum(F.when(known, F.col("word_count"))).alias("words"), *(F.count_if(F.col("band") == b).alias(b) for b in ("LIKELY_AI", "UNCERTAIN", "LIKELY_HUMAN")),
        *(x for m in BASE for x in mergeable(F.when(pre, F.coalesce(m, F.lit(0.0))), m)), *mergeable(F.col("p_ai"), "p"), *sums,
    )
    vectors = vector_sums(docs.where(pre), KEYS)
    same = None
    for k in KEYS:
        same = counts[k].eqNullSafe(vectors[k]) if same is None else same & counts[k].eqNullSafe(vectors[k])
    return counts.join(vectors, same, "left").select(counts["*"], F.coalesce("vectors", F.lit(0)).alias("vectors"), "vector_sum")


def vector_sums(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, vectors, vector_sum of the rows with a vector, by partial sums of places."""
    places = docs.where(F.size("embedding") > 0).select(*keys, F.posexplode("embedding").alias("_i", "_x"))
    places = places.groupBy(*keys, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    return places.groupBy(*keys).agg(F.max("_n").alias("vectors"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias("vector_sum"))


def _stored(docs: DataFrame) -> list[tuple[str, Column]]:
    """Sums of stored scores: p times words, and each signal with its number of values."""
    value = lambda c: views.third(F.col(c)) if c in ("stock", "recency") else F.col(c)
    out = [("p_words", F.col("p_ai") * F.col("word_count"))]
    for name, c in views.SIGNAL_MEANS:
        if c in docs.columns:
            out += [(f"sum_{name}", value(c)), (f"count_{name}", F.when(F.col(c).isNotNull(), 1))]
    return out


#: Squared deviations are merged around this value, which is near the means of all measures.
NEAR = 0.5


def merged(names: tuple[str, ...]) -> list[Column]:
    """Aggregates over cells: n, mean and sample deviation (null for one value) of each of ``names``."""
    out = []
    for m in names:
        n, mean, m2 = F.col(f"{m}_n"), F.col(f"{m}_mean"), F.col(f"{m}_m2")
        total = F.coalesce(F.sum(n), F.lit(0))
        middle = F.try_divide(F.sum(n * (mean - NEAR)), total)
        spread = F.sum(m2 + F.when(n > 0, n * (mean - NEAR) ** 2).otherwise(0.0)) - total * middle**2
        out += [total.alias(f"{m}_n"), (middle + NEAR).alias(f"{m}_mean"), F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.greatest(total - 1, F.lit(1)))).alias(f"{m}_sd")]
    return out


@dataclass(frozen=True)
class Baseline:
    """centroid: None if no earlier-dated document of the scope has a vector; moments: n, mean and sd by measure."""

    centroid: list[float] | None
    moments: dict[str, float | int | None]


def baseline(part: DataFrame) -> Baseline:
    """The baseline of merged cells: one row, and a row for each place of a vector, come to the driver."""
    places = part.where("vectors > 0").select(F.posexplode("vector_sum").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    row, vector = part.agg(*merged(BASE)).first().asDict(), {r.i: r.x for r in places.collect()}
    total = [vector[i] for i in range(len(vector))]
    length = sum(x * x for x in total) ** 0.5
    return Baseline([x / length if length else 0.0 for x in total] if total else None, row)


def scope(table: DataFrame, datasets: DataFrame, dataset_id: int | None = None, topic: str = "", ids: DataFrame | None = None) -> DataFrame:
    """Rows or cells of a collection (or of all but hidden ones), of a topic and, for rows, of ids: plain predicates, which scans push down."""
    live = datasets.where(F.col("kind") != views.HIDDEN) if dataset_id is None else datasets.where(F.col("dataset_id") == dataset_id)
    out = table.where(F.col("dataset_id") == dataset_id) if dataset_id is not None else table
    out = out.join(F.broadcast(live.select("dataset_id").distinct()), "dataset_id", "left_semi")
    if topic.strip():
        out = out.where(matches(F.col("topic"), needle(table.sparkSession, topic)))
    return out.join(ids, "id", "left_semi") if ids is not None else out


def rank_of(counts: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """(value, out): of whole values with their numbers of rows, (ties averaged) rank / (n - 1); 0.5 for one row.

    Buckets of neighbouring values are summed first: a window then runs over buckets, and one over the
    different values of each bucket, of which there are at most 2**BUCKET; no task sorts a scope.
    """
    counts = counts.where(F.col(n) > 0).withColumn("_bucket", F.shiftright(value, BUCKET))
    below = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("_bucket").agg(F.sum(n).alias("_s"))
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_s").over(below(Window.orderBy("_bucket"))), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy()).alias("_n"))
    inside = F.coalesce(F.sum(n).over(below(Window.partitionBy("_bucket").orderBy(value))), F.lit(0))
    rows = counts.withColumn("_i", inside).join(F.broadcast(sizes), "_bucket")
    rank = F.when(F.col("_n") > 1, (F.col("_b") + F.col("_i") + (F.col(n) - 1) / 2) / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.5)
    return rows.select(value, rank.alias(out))


def scored_view(rows: DataFrame, base: Baseline) -> DataFrame:
    """``rows_of`` rows of a scope with signals, p_ai, ci_low, ci_high and band, calibrated on its merged ``base``; without one, stored scores.

    The same values as ``score.era_scores`` with ``keep_stored``: one table of the rows with their distances is written.
    """
    if base.centroid is None:
        return score.forced_human(rows).withColumn("have_pre", F.lit(False)).drop("embedding")
    centre = F.expr(f"array({', '.join(f'{x!r}D' for x in base.centroid)})")
    known = F.coalesce(F.size("embedding") > 0, F.lit(False))
    far = F.when(known, F.round(1 - cosine(F.col("embedding"), centre), 9)).otherwise(0.5)
    whole = lambda c: F.round(F.col(c) * 1e9).cast("long")
    docs = rows.drop(*score.STORED).withColumns({"distance": far, "vector": known, "have_pre": F.lit(True)}).withColumn("_d", whole("distance"))
    docs = materialize(docs.drop("embedding"), "distances", shared_dir(rows.sparkSession))
    counts = docs.groupBy("_d").agg(F.count("*").alias("_k"), F.count_if(F.col("pre") & F.col("vector")).alias("_kp"))
    x, k = F.col("_d") / 1e9, F.col("_kp")
    mean = counts.agg(F.sum(k).alias("distance_n"), F.try_divide(F.sum(x * k), F.sum(k)).alias("distance_mean"))
    spread = counts.crossJoin(F.broadcast(mean)).agg(F.first("distance_n").alias("distance_n"), F.first("distance_mean").alias("distance_mean"), F.sum(k * (x - F.col("distance_mean")) ** 2).alias("_m2"))
    spread = spread.select("distance_n", "distance_mean", F.when(F.col("distance_n") > 1, F.sqrt(F.col("_m2") / (F.col("distance_n") - 1))).alias("distance_sd"))
    docs = docs.join(rank_of(counts, "_d", "_k", "anomaly_rank"), "_d").drop("_d").crossJoin(F.broadcast(spread))
    docs = docs.withColumns({name: F.lit(v).cast("long" if name.endswith("_n") else "double") for name, v in base.moments.items()})
    docs = score.with_raw(docs).withColumn("_p", whole("raw_p"))
    later = docs.where("NOT pre").groupBy("_p").agg(F.count("*").alias("_k"))
    docs = docs.join(rank_of(later, "_p", "_k", "_rank"), "_p", "left").drop("_p")
    return score.with_bands(docs.withColumn("_rank", F.coalesce("_rank", F.lit(0.5))))


def view(rows: DataFrame, cube: DataFrame, datasets: DataFrame, dataset_id: int | None = None, topic: str = "", ids: DataFrame | None = None) -> DataFrame:
    """Scored documents of a view, from the stored rows and cells; an id view's cells are those of its own rows."""
    shown = scope(rows, datasets, dataset_id, topic, ids)
    part = scope(cube, datasets, dataset_id, topic) if ids is None else cells(shown)
    wiki = F.coalesce("_wiki_set", F.lit(False)) | ((ascii_lower(F.col("source")) == "wikipedia.org") if dataset_id is None else F.lit(False))
    shown = shown.join(F.broadcast(views.encyclopedias(datasets).withColumn("_wiki_set", F.lit(True))), "dataset_id", "left")
    shown = shown.withColumn("subtopic", F.when((F.col("topic") != "") & F.coalesce(wiki, F.lit(False)), "").otherwise(F.col("subtopic"))).drop("_wiki_set")
    return scored_view(shown, baseline(part))


def stored_summary(part: DataFrame, metric: str = "documents") -> DataFrame:
    """As ``views.summary`` of stored scores, from cells alone."""
    one = part.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.sum("words").alias("_w"), F.sum("p_words").alias("_pw"), *(F.coalesce(F.sum(b), F.lit(0)).alias(b.lower()) for b in ("LIKELY_AI", "UNCERTAIN", "LIKELY_HUMAN")),
        *(F.coalesce(views.third(F.try_divide(F.sum(f"sum_{name}"), F.sum(f"count_{name}"))), F.lit(0.0)).alias(f"mean_{name}") for name, _ in views.SIGNAL_MEANS if f"sum_{name}" in part.columns),
        *merged(("p",)),
    )
    return views.summary_of(one.withColumnsRenamed({"p_n": "scored", "p_mean": "_mean", "p_sd": "_sd"}), metric)
