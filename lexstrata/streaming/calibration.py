"""Calibration of a document stream: mergeable state in versioned commits, new rows scored, moved collections rescored.

A store is a folder of tables with a part for each batch: ``features``; ``cells``, each collection's counts, baseline
moments and baseline vector sum of the batch alone; ``distances``, to the collection's centroid as of the batch; ``work``,
what the batch had to score; ``commits``. The state of a collection is the merged cells of all
committed batches. A batch moves a collection's centroid if it brings baseline vectors (or the collection still has
none): then all rows of that collection get new distances, of other collections the batch's own rows alone. A
batch that runs again writes its own parts anew, so a failure repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexstrata.functions.embed import dot
from lexstrata.operators import cube, score
from lexstrata.storage import exists, materialize, shared_dir

BY = "dataset_id"
ALL = tuple(f"all_{m}" for m in cube.BASE)


def _part(store: str, kind: str, batch: int) -> str:
    return f"{store}/{kind}/batch={batch}"


def _read(spark: SparkSession, store: str, kind: str, until: int) -> DataFrame:
    """A table's parts up to a batch; commits say which batches are whole."""
    return spark.read.option("basePath", f"{store}/{kind}").parquet(f"{store}/{kind}").where(F.col("batch") <= until)


def committed(spark: SparkSession, store: str) -> int:
    """The last whole batch, or -1."""
    if not exists(spark, f"{store}/commits"):
        return -1
    return _read(spark, store, "commits", 2**31 - 1).agg(F.max("batch")).first()[0]


def batch_cells(rows: DataFrame) -> DataFrame:
    """(dataset_id, documents, moments of the baseline and of all rows, vectors, vector_sum) of featured rows."""
    pre = F.coalesce((F.col("year") > 0) & (F.col("year") < 2019), F.lit(False))
    rows = rows.withColumn("pre", pre)
    value = lambda m: F.coalesce(m, F.lit(0.0))
    sums = [x for m in cube.BASE for x in (*cube.mergeable(F.when(F.col("pre"), value(m)), m), *cube.mergeable(value(m), f"all_{m}"))]
    counts = rows.groupBy(BY).agg(F.count("*").alias("documents"), *sums)
    return counts.join(cube.vector_sums(rows.where("pre"), (BY,)), BY, "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))


def state(cells: DataFrame) -> DataFrame:
    """(dataset_id, n, have_pre, moments): merged cells; a collection without baseline vectors has the moments of all its rows."""
    one = cells.groupBy(BY).agg(F.sum("documents").alias("n"), (F.sum("vectors") > 0).alias("have_pre"), *cube.merged((*cube.BASE, *ALL)))
    pick = lambda m, k: F.when(F.col("have_pre"), F.col(f"{m}_{k}")).otherwise(F.col(f"all_{m}_{k}")).alias(f"{m}_{k}")
    return one.select(BY, "n", "have_pre", *(pick(m, k) for m in cube.BASE for k in ("mean", "sd", "n")))


def _centroids(cells: DataFrame) -> DataFrame:
    places = cells.where("vectors > 0").select(BY, F.posexplode("vector_sum").alias("i", "x")).groupBy(BY, "i").agg(F.sum("x").alias("x"))
    whole = places.groupBy(BY).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return whole.select(BY, F.transform("c", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("centroid"))


def process(batch: DataFrame, number: int, store: str) -> None:
    """Adds a batch of documents (id, dataset_id, title, text, dates, ...): rows whose id is stored already are left out."""
    spark, folder = batch.sparkSession, shared_dir(batch.sparkSession)
    new = batch.dropDuplicates(["id"])
    if number > 0 and committed(spark, store) >= 0:
        new = new.join(_read(spark, store, "features", number - 1).select("id"), "id", "left_anti")
    write = lambda df, kind: df.write.mode("overwrite").option("compression", "zstd").parquet(_part(store, kind, number))
    write(score.featured(new).drop("text"), "features")
    write(batch_cells(_read(spark, store, "features", number).where(F.col("batch") == number)), "cells")
    cells, features = _read(spark, store, "cells", number), _read(spark, store, "features", number)
    now = state(cells).select(BY, "n", "have_pre")
    brought = cells.where(F.col("batch") == number).select(BY, (F.col("vectors") > 0).alias("moved"))
    work = materialize(brought.join(now, BY).select(BY, "n", "have_pre", (F.col("moved") | ~F.col("have_pre")).alias("rescored")), "work", folder)
    rows = features.join(work, BY).where(F.col("rescored") | (F.col("batch") == number)).drop("batch", "rescored")
    rows = rows.withColumn("pre", F.coalesce((F.col("year") > 0) & (F.col("year") < 2019), F.lit(False)))
    bare = rows.where("NOT have_pre").drop("n", "have_pre")
    found = _centroids(cells).unionByName(score._centres(bare, work.where("NOT have_pre"), BY, folder))
    far = score.distanced(rows.drop("n", "have_pre").join(found, BY, "left"))
    write(far, "distances")
    scored = _read(spark, store, "distances", number).where(F.col("batch") == number).groupBy(BY).agg(F.count("*").alias("rows"))
    write(work.join(scored, BY, "left").select(BY, "rescored", F.coalesce("rows", F.lit(0)).alias("rows")), "work")
    write(work.agg(F.count("*").alias("collections")), "commits")


def scores(spark: SparkSession, store: str) -> DataFrame:
    """Every stored document's signals, p_ai, ci_low, ci_high and band: what calibrating all of them at once gives."""
    last = committed(spark, store)
    valid = _read(spark, store, "work", last).where("rescored").groupBy(BY).agg(F.max("batch").alias("since"))
    docs = _read(spark, store, "distances", last).join(valid, BY).where(F.col("batch") >= F.col("since")).drop("since", "batch")
    known = materialize(state(_read(spark, store, "cells", last)), "state", shared_dir(spark))
    docs = docs.join(known.select(BY, "have_pre"), BY)
    stats = known.drop("n", "have_pre").join(score.moments(docs, BY, ("distance",)), BY)
    return score.calibrated(docs, BY, shared_dir(spark), stats)


def history(spark: SparkSession, store: str) -> DataFrame:
    """(batch, dataset_id, rescored, rows): what each batch had to score."""
    return _read(spark, store, "work", committed(spark, store)).select("batch", BY, "rescored", "rows")


def calibrate_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Runs ``process`` over all that a document stream has now, batch by batch."""
    one = lambda batch, number: process(batch, number, store)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
