"""Readers: uploaded files (text, JSON lines, zip members), news rows, article extracts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions import naming
from lexstrata.functions.html import news_text, parse_html, parse_page, stamp_date
from lexstrata.functions.text import ascii_lower, clip_bytes, guess_topic, trimmed, word_tokens
from lexstrata.functions.topics import COUNTRIES, kept_topic, news_topics, with_accepted, with_canonical
from lexstrata.functions.urls import dedup_key, host_of, news_title, normalize_url
from lexstrata.operators import reports
from lexstrata.sources.pdf import pdf_text
from lexstrata.storage import materialize, shared_dir

JSON_FIELDS = "title string, text string, url string, topic string, source string"
DOCUMENT = ("title", "text", "url", "topic", "source", "word_count")


def as_documents(rows: DataFrame, kind: str = "USER_UPLOAD") -> DataFrame:
    """Rows (title, text, url, topic, source) as documents: blank texts go, titles default, topics are guessed, urls clipped.

    Documents of an encyclopedia (by ``kind`` of the collection, or by source) get canonical topics; of others a topic that
    names a shared country gets its shared name.
    """
    text = trimmed(F.coalesce("text", F.lit("")))
    blank = lambda c: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
    guessed = guess_topic(F.concat_ws(" ", F.coalesce("title", F.lit("")), text))
    step = rows.select(
        F.when(blank("title").isNull(), "Untitled").otherwise(F.col("title")).alias("title"), text.alias("text"), clip_bytes(F.coalesce("url", F.lit("")), 2000).alias("url"),
        F.coalesce(blank("topic"), guessed).alias("topic"), F.coalesce(blank("source"), F.lit("")).alias("source"),
    ).where("text <> ''")
    wiki = F.lit(kind == "WIKIPEDIA_SAMPLE") | (ascii_lower(F.col("source")) == "wikipedia.org")
    step = with_canonical(step.withColumn("_name", F.when(wiki, F.col("title")).otherwise(F.col("topic"))), "topic", "_name", "_shared")
    topic = F.when(wiki | (kept_topic(F.col("_shared")) != ""), F.col("_shared")).otherwise(F.col("topic"))
    return step.withColumn("topic", topic).drop("_name", "_shared").withColumn("word_count", F.size(word_tokens(F.col("text"))))


def json_lines(lines: DataFrame, source: str) -> DataFrame:
    """Documents from a column ``value`` of JSON objects; lines that aren't objects give nothing. Escapes are decoded."""
    rows = lines.select(F.from_json("value", JSON_FIELDS).alias("r")).where("r IS NOT NULL").select("r.*")
    blank = F.trim(F.coalesce("source", F.lit(""))) == ""
    return as_documents(rows.withColumn("source", F.when(blank, source).otherwise(F.col("source"))))


#: Greatest size of one member of an archive; greater ones are left out.
MEMBER_BYTES = 1 << 28


def _members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """A file, or the members of an archive one after another; unreadable ones are left out."""
    if not name.lower().endswith(".zip"):
        yield name, raw
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if info.is_dir() or info.file_size > MEMBER_BYTES:
                    continue
                try:
                    yield info.filename, z.read(info)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    continue
    except zipfile.BadZipFile:
        return


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """name, kind and, as the kind is, JSON lines or a title and text of each file and archive member."""
    for batch in batches:
        for path, raw in zip(batch.path, batch.content):
            for name, data in _members(path, raw):
                own = name.replace("\\", "/").rpartition("/")[2]
                low, title = own.lower(), own
                if low.endswith(".jsonl"):
                    yield pd.DataFrame({"name": [own], "lines": [True], "title": [""], "text": [data.decode("utf-8", "replace")]})
                    continue
                if low.endswith(".pdf"):
                    text = pdf_text(data)
                else:
                    text = data.decode("utf-8", "replace")
                    if low.endswith((".html", ".htm")):
                        page = parse_page(text)
                        title, text = page.title.strip() or title, page.body
                dot = title.rfind(".")
                yield pd.DataFrame({"name": [own], "lines": [False], "title": [title[:dot] if dot > 0 else title], "text": [text]})


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Text, HTML, PDF, JSON-lines and zip files below ``path`` as documents; unreadable members and empty texts are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, "name string, lines boolean, title string, text string")
    lines = files.where("lines").select("name", F.explode(F.split("text", "\n")).alias("value"))
    one = lines.select(F.from_json("value", JSON_FIELDS).alias("r"), "name").where("r IS NOT NULL").select("r.*", "name")
    blank = F.trim(F.coalesce("source", F.lit(""))) == ""
    rows = one.withColumn("source", F.when(blank, F.col("name")).otherwise(F.col("source"))).drop("name")
    other = files.where("NOT lines").select("title", "text", F.lit("").alias("url"), F.lit("").alias("topic"), F.col("name").alias("source"))
    return as_documents(rows.unionByName(other))


def ingest_uploads(spark: SparkSession, path: str, datasets: DataFrame, name: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(the new collection's row, its documents) of the files below ``path``; an error where they hold no text, or the cap is reached.

    The collection has the name asked for, or that of its files, with a number if it is taken.
    """
    shown = datasets.where("kind <> 'WIKIPEDIA_SUBSET'").select("dataset_id", "name").limit(1000).collect()  # a catalog has at most CAP shown rows
    if len(shown) >= 7:
        raise ValueError("no more collections can be added")
    documents = materialize(read_uploads(spark, path), "uploads")
    if documents.isEmpty():
        raise ValueError("no extractable documents in the upload")
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(2).collect()]
    taken = {r.name.lower() for r in shown}
    chosen = naming.free_name(naming.upload_name(name, files), "USER_UPLOAD", lambda n: n.lower() in taken, now)
    number = 1 + (datasets.agg(F.max("dataset_id")).first()[0] or 0)
    row = spark.createDataFrame([(number, chosen, "USER_UPLOAD", now)], "dataset_id long, name string, kind string, created_at string")
    return row, documents.withColumn("dataset_id", F.lit(number))


def crawled_documents(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html, seed_url) as documents: title and text of the page, source the seed."""
    page = parse_html(F.col("html"))
    rows = pages.select("url", "seed_url", page.alias("_p")).select(F.col("_p.title").alias("title"), F.col("_p.body").alias("text"), "url", F.lit("").alias("topic"), "seed_url")
    return as_documents(rows.withColumn("source", F.coalesce(F.nullif("seed_url", F.lit("")), host_of(F.col("url")), F.lit("url"))))


def news_rows(lines: DataFrame) -> DataFrame:
    """(seen, stamp, source, url, locations, codes) of tab-separated rows of 11 fields or more with an http address."""
    f = F.split(F.regexp_replace("value", "\r", ""), "\t")
    rows = lines.select(f.alias("f")).where(F.size("f") >= 11)
    g = lambda i: F.col("f")[i]
    rows = rows.select(stamp_date(g(1)).alias("seen"), g(1).alias("stamp"), trimmed(g(3)).alias("source"), trimmed(g(4)).alias("url"), g(9).alias("locations"), g(10).alias("codes"))
    return rows.where(F.col("url").startswith("http"))


#: Rows of a run of news rows that one task assigns, with the places that earlier runs have left.
RUN_ROWS = 200_000


def assigned_in_order(choices: DataFrame, caps: dict[str, int], rows: int | None = None) -> DataFrame:
    """(place, row, pick) of the rows that are stored when they come one by one, in order of ``place`` and ``row``.

    ``choices``: a row for each country ``pick`` that a news row names, in order of ``n``, with ``topic``, under which it would be stored
    (null if it can't be), and its ``key``. A row of one country goes to it while it has places; one of several to
    that with the most places left, the first of equals. It is stored if its topic has a place and its key isn't stored yet.

    Each row depends on those before, so runs of sorted rows follow each other, each in one task that takes the places left and
    the stored keys (no more than all places) and gives them on. Rows whose countries are all full are left out
    of a run before it starts, and runs end when all are full.
    """
    spark, folder = choices.sparkSession, shared_dir(choices.sparkSession)
    runs = max(1, -(-choices.count() // (rows or RUN_ROWS)))
    ordered = choices.repartitionByRange(runs, "place", "row").withColumn("run", F.spark_partition_id()).sortWithinPartitions("place", "row", "n")
    ordered.write.partitionBy("run").option("compression", "zstd").parquet(f"{folder}/ordered")
    table = spark.read.schema(ordered.schema).parquet(f"{folder}/ordered")
    left, keys, stored = dict(caps), set(), []
    for run in range(runs):
        full = [t for t, n in left.items() if n <= 0]
        if len(full) == len(caps):
            break
        some = table.where(F.col("run") == run)
        some = some.join(some.where(~F.col("pick").isin(full)).select("place", "row").distinct(), ["place", "row"], "left_semi") if full else some
        now, have = dict(left), set(keys)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames, out = list(frames), []
            frame = pd.concat(frames, ignore_index=True).sort_values(["place", "row", "n"]) if frames else None
            for (place, row), part in frame.groupby(["place", "row"], sort=False) if frames else ():
                need = [now[p] for p in part["pick"]]
                best = max(range(len(need)), key=lambda i: (need[i], -i))
                topic, key = part["topic"].iloc[best], part["key"].iloc[best]
                if need[best] > 0 and topic is not None and now[topic] > 0 and (key is None or key not in have):
                    now[topic] -= 1
                    if key is not None:
                        have.add(key)
                    out.append((place, row, part["pick"].iloc[best], topic, key))
            yield pd.DataFrame(out, columns=["place", "row", "pick", "topic", "key"])

        taken = some.select("place", "row", "n", "pick", "topic", "key").coalesce(1).mapInPandas(assign, "place string, row long, pick string, topic string, key string").collect()
        stored += [(r.place, r.row, r.pick) for r in taken]
        for r in taken:
            left[r.topic] -= 1
        keys |= {r.key for r in taken if r.key is not None}
    return spark.createDataFrame(stored, "place string, row long, pick string")


def news_documents(lines: DataFrame, cap: int = 1000, germany: int = 1000) -> DataFrame:
    """Documents of news rows in order of address: one country each, one address once, at most ``cap`` of a country (``germany`` at most of Germany's).

    A row that names several countries goes to the one with the most places left so far.
    """
    rows = news_rows(lines).withColumn("url", F.coalesce(normalize_url(F.col("url")), F.col("url"))).distinct()
    rows = rows.withColumn("row", F.xxhash64("url", "stamp", "source", "locations", "codes"))
    picked = rows.select("*", F.posexplode(news_topics(F.col("locations"), F.col("codes"))).alias("n", "pick")).withColumn("title", news_title(F.col("url"), F.col("source")))
    text = news_text(F.col("title"), F.col("url"), F.col("stamp"), F.col("source"), F.col("pick"), F.lit("English"), F.col("pick"))
    picked = with_accepted(picked.withColumn("text", text), "title", "text", "pick", "topic")
    picked = materialize(picked.withColumn("topic", F.when(F.size(word_tokens(F.col("text"))) >= 40, F.col("topic"))), "picked")
    caps = {c: min(cap, germany) if c == "Germany" else cap for c in COUNTRIES}
    chosen = assigned_in_order(picked.select(F.col("url").alias("place"), "row", "n", "pick", "topic", dedup_key(F.col("url")).alias("key")), caps)
    found = picked.join(F.broadcast(chosen.withColumnRenamed("place", "url")), ["url", "row", "pick"], "left_semi")  # no more rows than places
    return found.select("url", "title", "text", "topic", "source", "seen")


def articles(payload: DataFrame) -> DataFrame:
    """url, title, seendate, domain from JSON {articles: [...]} in column ``value``."""
    kind = "articles array<struct<url: string, title: string, seendate: string, domain: string, sourcecountry: string, language: string>>"
    return payload.select(F.inline(F.from_json("value", kind)["articles"]))


ALIASES = "array<struct<`from`: string, `to`: string>>"
QUERY = f"query struct<normalized: {ALIASES}, redirects: {ALIASES}, pages: array<struct<title: string, extract: string, missing: boolean, revisions: array<struct<timestamp: string>>>>>"


def _by_title(payload: DataFrame, value: str) -> DataFrame:
    """(title, value) of JSON payloads in column ``value``; a title that stands for another page has that page's value.

    ``value`` is an expression over a page ``p``; pages that are missing, untitled or without a value go. Of
    equal titles the last page counts, of equal aliases the last one, redirects after normalized titles.
    """
    rows = payload.select(F.from_json("value", QUERY).alias("r")).where("r.query IS NOT NULL").select("r.query.*")
    rows = rows.selectExpr(
        f"filter(transform(coalesce(pages, array()), p -> struct(p.title as title, {value} as value, coalesce(p.missing, false) as gone)), p -> NOT p.gone AND coalesce(p.title, '') <> '' AND p.value IS NOT NULL) AS p",
        "filter(concat(coalesce(normalized, array()), coalesce(redirects, array())), a -> coalesce(a.`from`, '') <> '' AND coalesce(a.`to`, '') <> '') AS a",
    )
    rows = rows.selectExpr("filter(p, (x, i) -> NOT exists(slice(p, i + 2, size(p)), y -> y.title = x.title)) AS p", "filter(a, (x, i) -> NOT exists(slice(a, i + 2, size(a)), y -> y.`from` = x.`from`)) AS a")
    rows = rows.selectExpr("p", "filter(transform(a, x -> struct(x.`from` as title, filter(p, y -> y.title = x.`to`) as hit)), x -> size(x.hit) > 0) AS a")
    named = rows.selectExpr("concat(transform(a, x -> struct(x.title as title, x.hit[0].value as value)), transform(filter(p, x -> NOT exists(a, y -> y.title = x.title)), x -> struct(x.title as title, x.value as value))) AS out")
    return named.select(F.inline("out"))


def article_extracts(payload: DataFrame) -> DataFrame:
    """(title, value) of article texts; blank ones go."""
    return _by_title(payload, r"if(regexp_replace(coalesce(p.extract, ''), '[ \\t\\n\\x0B\\f\\r]', '') <> '', p.extract, NULL)")


def revision_dates(payload: DataFrame) -> DataFrame:
    """(title, value) of the first revision's date, YYYY-MM-DD."""
    return _by_title(payload, r"nullif(regexp_extract(coalesce(get(p.revisions, 0).timestamp, ''), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '')")
