"""Catalog operations: lookups, cascades, retention, conditional updates, run metadata.

Tables are values: every operation returns the tables as they are afterwards.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexstrata.functions.text import ascii_lower, trimmed
from lexstrata.functions.topics import is_encyclopedia_name, with_canonical
from lexstrata.functions.urls import article_title
from lexstrata.operators.reports import collapsed_dates

# Kinds of collections, the names of the standing ones, and how many may show.
WIKI, SUBSET, NEWS, UPLOAD, URLS = "WIKIPEDIA_SAMPLE", "WIKIPEDIA_SUBSET", "GDELT", "USER_UPLOAD", "USER_URLS"
WIKI_NAME, NEWS_NAME = "Wikipedia", "GDELT"
CAP = 7


class Store(NamedTuple):
    """datasets (dataset_id, name, kind, created_at, ...), documents (id, dataset_id, ...), edges (dataset_id, src, dst, ...)."""

    datasets: DataFrame
    documents: DataFrame
    edges: DataFrame


def is_wiki() -> Column:
    return F.col("kind").isin(WIKI, SUBSET) | is_encyclopedia_name(F.col("name"))


def is_news() -> Column:
    return (F.col("kind") == NEWS) | (ascii_lower(trimmed(F.col("name"))) == NEWS_NAME.lower())


# Lookups ---------------------------------------------------------------------


def get(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row of an id (a document, a collection, a run), or none."""
    return rows.where(F.col(key) == value).limit(1)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def edges_of(edges: DataFrame, dataset_id: int, src: int | None = None) -> DataFrame:
    """A collection's edges, or those from one document of it."""
    found = edges.where(F.col("dataset_id") == dataset_id)
    return found if src is None else found.where(F.col("src") == src)


def find_datasets(datasets: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Collections of a name (in any case) and of a kind, newest first; the first row is the one that lookups of one give."""
    found = datasets if name is None else datasets.where(ascii_lower(F.col("name")) == ascii_lower(F.lit(name)))
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found.orderBy(F.desc("created_at"), F.desc("dataset_id"))


def counts(datasets: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: all documents of visible collections, those without a score, visible collections, and whether the cap is reached."""
    visible = datasets.where(F.col("kind") != SUBSET)
    seen = docs.join(F.broadcast(visible.select("dataset_id").distinct()), "dataset_id", "left_semi")
    one = seen.agg(F.count("*").alias("documents"), F.count_if(F.col("p_ai").isNull()).alias("unscored"))
    return one.join(F.broadcast(visible.agg(F.count("*").alias("datasets"))), F.lit(True)).withColumn("full", F.col("datasets") >= CAP)


def stored_topic_counts(docs: DataFrame) -> DataFrame:
    return docs.where("topic <> ''").groupBy("dataset_id", "topic").agg(F.count("*").alias("documents"))


def list_datasets(datasets: DataFrame, docs: DataFrame) -> DataFrame:
    """Visible collections with counts and flags; encyclopedia first, then news, then others, newest first."""
    n = docs.groupBy("dataset_id").agg(F.count("*").alias("documents"))
    rows = datasets.where(F.col("kind") != SUBSET).join(n, "dataset_id", "left")
    order = F.when(F.col("kind") == WIKI, 0).when(F.col("kind") == NEWS, 1).otherwise(2)
    flags = {"documents": F.coalesce("documents", F.lit(0)), "wikipedia": is_wiki(), "gdelt": is_news(), "deletable": ~is_wiki() & ~is_news(), "place": order}
    return rows.select("dataset_id", "name", "kind", "created_at", *(c.alias(k) for k, c in flags.items())).orderBy("place", F.desc("created_at"))


# Deletes ---------------------------------------------------------------------


def swept(store: Store) -> Store:
    """Without documents of no collection, and without edges of no collection or with an end that is gone. Null keys go too."""
    docs = store.documents.join(store.datasets.select("dataset_id").distinct(), "dataset_id", "left_semi")
    ids = docs.select("id").distinct()
    edges = store.edges.join(store.datasets.select("dataset_id").distinct(), "dataset_id", "left_semi")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return Store(store.datasets, docs, edges)


def delete_dataset(store: Store, dataset_id: int) -> Store:
    """Without the collection, those whose parent it is (column ``parent_dataset_id``, if there), and all that hangs on them."""
    gone = F.col("dataset_id") == dataset_id
    if "parent_dataset_id" in store.datasets.columns:
        gone = gone | F.coalesce(F.col("parent_dataset_id") == dataset_id, F.lit(False))
    return swept(store._replace(datasets=store.datasets.where(~gone)))


def delete_short(store: Store, dataset_id: int, words: int) -> tuple[Store, DataFrame]:
    """Without a collection's documents of under ``words`` words and their edges; and one row with how many went."""
    short = (F.col("dataset_id") == dataset_id) & (F.coalesce("word_count", F.lit(0)) < words)
    gone = store.documents.where(short)
    edges = store.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Store(store.datasets, store.documents.where(~short), edges), gone.agg(F.count("*").alias("deleted"))


def clear_dataset(store: Store, dataset_id: int) -> Store:
    """Without the collection's documents and edges; the collection stays."""
    other = F.col("dataset_id") != dataset_id
    return Store(store.datasets, store.documents.where(other), store.edges.where(other))


def replace_edges(store: Store, dataset_id: int, edges: DataFrame) -> Store:
    """The collection's edges are ``edges`` (src, dst, cosine, reason)."""
    new = edges.withColumn("dataset_id", F.lit(dataset_id))
    return store._replace(edges=store.edges.where(F.col("dataset_id") != dataset_id).unionByName(new.select(*store.edges.columns)))


# Updates ---------------------------------------------------------------------


def set_column(docs: DataFrame, values: DataFrame, name: str, only_empty: bool = True) -> DataFrame:
    """``name`` from (id, value): where it is null or '' alone, unless ``only_empty`` is off. Of several values of an id the least counts."""
    new = values.groupBy("id").agg(F.min("value").alias("_new"))
    empty = F.coalesce(F.col(name), F.lit("")) == ""
    value = F.when(empty | F.lit(not only_empty), F.coalesce("_new", name)).otherwise(F.col(name))
    return docs.join(new, "id", "left").withColumn(name, value).drop("_new")


def title_key(docs: DataFrame) -> Column:
    """The title of an article's address, or else the document's, with blanks for '_'."""
    title = F.coalesce(article_title(F.col("url")), F.col("title")) if "url" in docs.columns else F.col("title")
    return trimmed(F.translate(title, "_", " "))


def set_dates(docs: DataFrame, dates: DataFrame, overwrite: bool = False, column: str = "created_at") -> DataFrame:
    """``column`` from (title, date): the exact title first, else the least date of one folded title; only where missing, unless ``overwrite``.

    Titles compare with blanks for '_'; letters fold A-Z alone; dates under 4 characters don't count.
    """
    rows = dates.where(F.length("date") >= 4).withColumn("title", trimmed(F.translate("title", "_", " ")))
    exact = rows.groupBy(F.col("title").alias("_key")).agg(F.min("date").alias("_exact"))
    folded = rows.groupBy(ascii_lower(F.col("title")).alias("_low")).agg(F.min("date").alias("_folded"))
    joined = docs.withColumn("_key", title_key(docs)).withColumn("_low", ascii_lower(F.col("_key"))).join(exact, "_key", "left").join(folded, "_low", "left")
    found = F.coalesce("_exact", "_folded")
    have = F.nullif(F.col(column), F.lit(""))
    return joined.withColumn(column, F.coalesce(found, column) if overwrite else F.coalesce(have, found, column)).drop("_key", "_low", "_exact", "_folded")


def backfill_created(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """created_at of documents with an address from (title, date): where missing, or everywhere in a collection whose dates have collapsed."""
    bad = F.broadcast(collapsed_dates(docs).where("collapsed").select("dataset_id", F.lit(True).alias("_all")))
    new = set_dates(docs, dates, overwrite=True).select("id", F.col("created_at").alias("_new"))
    due = (F.coalesce(F.col("url"), F.lit("")) != "") & (F.coalesce("_all", F.lit(False)) | (F.coalesce("created_at", F.lit("")) == ""))
    joined = docs.join(bad, "dataset_id", "left").join(new, "id", "left")
    return joined.withColumn("created_at", F.when(due, F.col("_new")).otherwise(F.col("created_at"))).drop("_all", "_new")


def normalize_topics(docs: DataFrame) -> DataFrame:
    """Stored topics as canonical ones."""
    return with_canonical(docs, "topic", "title", "topic").select(*docs.columns)


def merge_encyclopedias(datasets: DataFrame) -> DataFrame:
    """Leftover encyclopedia collections, but for hidden ones, get the standing name and kind."""
    left = is_wiki() & (F.col("kind") != SUBSET)
    return datasets.withColumns({"name": F.when(left, WIKI_NAME).otherwise(F.col("name")), "kind": F.when(left, WIKI).otherwise(F.col("kind"))})


def reuse_urls(store: Store, name: str) -> Store:
    """Of the address collections of a name the newest is kept, emptied; the others go with their contents."""
    same = find_datasets(store.datasets, name, URLS).select("dataset_id")
    first = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("dataset_id")))
    named = store.datasets.where((ascii_lower(F.col("name")) == ascii_lower(F.lit(name))) & (F.col("kind") == URLS))
    extra = named.withColumn("_r", first).where("_r > 1").select("dataset_id")
    empty = lambda df: df.join(F.broadcast(same), "dataset_id", "left_anti")
    return swept(Store(store.datasets.join(F.broadcast(extra), "dataset_id", "left_anti"), empty(store.documents), empty(store.edges)))


# Runs ------------------------------------------------------------------------

# The states of tasks that count as done, as in the run records.
DONE, CACHED, RUNNING, FAILED = "complete", "cached", "running", "failed"


def interrupted(rows: DataFrame, open_states: tuple[str, ...]) -> DataFrame:
    """Rows of an open state as failed, with the reason; for tasks these are running and ready, for runs running and pending."""
    was = F.col("status").isin(*open_states)
    return rows.withColumns({"status": F.when(was, FAILED).otherwise(F.col("status")), "error": F.when(was, "interrupted").otherwise(F.col("error"))})


def latest_run(runs: DataFrame) -> DataFrame:
    """The run of greatest id of each collection."""
    return runs.groupBy("dataset_id").agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


def with_dependencies(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Tasks with the sorted list of those they wait for."""
    lists = dependencies.groupBy(F.col("task_id").alias("id")).agg(F.sort_array(F.collect_set("depends_on")).alias("dependencies"))
    return tasks.join(lists, "id", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<bigint>")))


def run_progress(tasks: DataFrame) -> DataFrame:
    """Per task type: n, failed, total milliseconds."""
    return tasks.groupBy("task_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == FAILED).alias("failed"), F.round(F.sum("ms"), 2).alias("ms"))


def snapshot(tasks: DataFrame) -> DataFrame:
    """Per run: tasks by state (cached ones are completed too), percent completed, milliseconds and bytes."""
    s = F.col("status")
    done = F.count_if(s.isin(DONE, CACHED))
    other = ~s.isin(DONE, CACHED, RUNNING, FAILED)
    return tasks.groupBy("run_id").agg(
        F.count("*").alias("total"), done.alias("completed"), F.count_if(s == CACHED).alias("cached"), F.count_if(s == RUNNING).alias("running"),
        F.count_if(s == FAILED).alias("failed"), F.count_if(F.coalesce(other, F.lit(True))).alias("pending"), F.round(100.0 * done / F.count("*"), 6).alias("progress"),
        F.round(F.sum("ms"), 2).alias("ms"), F.sum("bytes").alias("bytes"),
    )


def era_compare(scored: DataFrame, cut: str = "2019-09-01") -> DataFrame:
    """Mean score before and from ``cut`` (full dates compare as text; a bare year 2019 is left out)."""
    d = F.col("date")
    dated = scored.where((d != "") & (F.col("year") > 0) & (d != "2019") & F.col("p_ai").isNotNull()).withColumn("_after", F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), d >= cut).otherwise(F.col("year") > 2019))
    side = lambda late: F.when(F.col("_after") if late else ~F.col("_after"), F.col("p_ai"))
    return dated.agg(F.count(side(False)).alias("n_before"), F.count(side(True)).alias("n_after"), F.round(F.avg(side(False)), 6).alias("mean_before"), F.round(F.avg(side(True)), 6).alias("mean_after"))


def pending(docs: DataFrame, features: DataFrame) -> DataFrame:
    """dataset_id, documents, pending, state: documents without features or score, and what that makes of each collection: ready or pending."""
    have = features.where("p_ai IS NOT NULL AND size(embedding) > 0").select("id", F.lit(True).alias("_have"))
    rows = docs.select("id", "dataset_id").join(have, "id", "left").groupBy("dataset_id")
    out = rows.agg(F.count("*").alias("documents"), F.count_if(F.col("_have").isNull()).alias("pending"))
    return out.withColumn("state", F.when(F.col("pending") == 0, "ready").otherwise("pending"))


# States of a collection's neighbourhood means.
NOT_TRAINED, EMBEDDED, VALIDATION_FAILED = "NOT_TRAINED", "EMBEDDED", "VALIDATION_FAILED"


def means_status(datasets: DataFrame, docs: DataFrame, labels: bool | None = None) -> DataFrame:
    """dataset_id, status: means need two documents; a request to train them fails without labels, and with them isn't validated."""
    n = docs.groupBy("dataset_id").agg(F.count("*").alias("_n"))
    made = F.when(F.coalesce("_n", F.lit(0)) >= 2, EMBEDDED).otherwise(NOT_TRAINED)
    asked = made if labels is None else F.lit(VALIDATION_FAILED if labels else NOT_TRAINED)
    return datasets.select("dataset_id").join(n, "dataset_id", "left").select("dataset_id", asked.alias("status"))
