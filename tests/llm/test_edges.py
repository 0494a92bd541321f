"""Nulls, empty tables, repeated rows, long texts and clashing column names, for each operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexstrata.llm import decontaminate, html_text, language_model, mixing, near_dedup, quality_rules, substring_dedup, suffix_dedup, url_filter, warc
from lexstrata.llm.storage import shared_dir

#: Names that operators use inside.
CLASHING = ("_key", "_digest", "_kept", "_row", "_w", "key", "digest", "tid", "blob", "words", "bucket", "root", "band", "host", "reader", "slice", "domain", "_part", "sha256", "block", "mix_rate", "rate", "p0", "train", "gram", "kept")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
LABELS = "doc_id long, quality int, toxic int, text string, `_good` string"
BENCH = "item_id long, text string, doc_id string"
PAGES = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING if c not in ("host",)) + ", host string"
RNG = random.Random(12)
LONG = " ".join(RNG.choice(("alpha", "beta", "gamma", "delta", "épsilon", "zeta")) + str(RNG.randrange(5000)) for _ in range(30000))
TEXT = " ".join(f"w{i}" for i in range(130))
ROWS = [(None, TEXT), (None, TEXT), (4, TEXT), (4, TEXT), (2, None), (2, " "), (7, ""), (8, LONG), (9, LONG + " end"), (10, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, *("x" for _ in CLASHING)) for i, t in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, None, "g"), (4, 0, 1, None, None), (None, 1, 1, "t", None), (8, 1, None, None, None), (9, 0, 0, None, None), (10, None, 0, None, None)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TEXT[:200], "d"), (1, None, None), (None, TEXT, None), (2, LONG[-400:], None), (3, "", None), (4, "one", None)], BENCH)


def results(docs, labels, bench):
    return {
        "mix": mixing.mix(docs, labels), "decontaminate": decontaminate.decontaminate(docs, bench), "quality": quality_rules.quality_rules(docs, labels),
        "substring": substring_dedup.substring_dedup(docs), "near": near_dedup.near_duplicates(docs), "suffix": suffix_dedup.suffix_dedup(docs), "model": language_model.classify(docs, labels),
    }


def test_every_row_has_a_result(docs, labels, bench):
    want = sorted(str(i) for i, _ in ROWS)
    for name, df in results(docs, labels, bench).items():
        assert sorted(str(r.doc_id) for r in df.collect()) == want, name


def test_what_the_rows_give(docs, labels, bench):
    of = lambda df: {(r.doc_id, r[1]) for r in df.collect()}
    r = results(docs, labels, bench)
    assert of(r["decontaminate"].where("contaminated").select("doc_id", "item_ids").withColumn("item_ids", F.col("item_ids").cast("string"))) == {(None, "[1]"), (4, "[1]"), (8, "[2]"), (9, "[2]"), (10, "[4]")}
    assert of(r["near"].select("doc_id", "component_id")) == {(None, None), (4, 4), (2, 2), (7, 7), (8, 8), (9, 8), (10, 10)}
    assert of(r["substring"].select("doc_id", "n_removed")) == {(None, 130), (4, 130), (None, 0), (2, 0), (7, 0), (8, 30000), (9, 30000), (10, 0)}
    n, m = len(TEXT), len(LONG.encode())
    assert of(r["suffix"].select("doc_id", "n_removed")) == {(None, 0), (4, n), (2, 0), (7, 0), (8, 0), (9, m), (10, 0)}
    assert not r["quality"].where("kept AND (text_null)".replace("(text_null)", "n_words = 0")).count()


def test_stages_keep_the_input_columns(spark, docs, labels, bench, tmp_path):
    sf = str(tmp_path / "sf")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{sf}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        extra = {"mix_rate"} if name == "source mixing" else set()
        assert set(out.columns) == set(docs.columns) | extra, name
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in CLASHING if c not in extra), name
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and set(none.columns) == set(out.columns), name


def test_empty_tables(spark, docs, labels, bench):
    for name, df in results(docs.limit(0), labels.limit(0), bench.limit(0)).items():
        assert df.count() == 0, name
    for name, df in results(docs, labels.limit(0), bench.limit(0)).items():
        assert df.count() == len(ROWS), name


def test_pages(spark):
    big = "<p>" + "é" * 60000 + "</p>"
    rows = [(1, "http://a.com/", big), (1, "http://a.com/", big), (None, "http://a.com/", big), (None, None, None), (3, "", ""), (2, "http://b.com/", big), (5, "http://b.com/", None)]
    pages = spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], PAGES)
    got = html_text.extract(pages)
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", 60000), ("1", 60000), ("2", 60000), ("3", 0), ("5", 0), ("None", 0), ("None", 60000)]
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    read = warc.read_archive(spark, path).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in read) == [
        ("1", 120007, "revisit", "2"), ("1", 120007, "revisit", "2"), ("2", 120007, "response", "None"), ("3", 0, "response", "None"), ("5", 0, "response", "None"),
        ("None", 0, "response", "None"), ("None", 120007, "revisit", "2"),
    ]
    assert sum(len(r.record) > 100000 for r in warc.rebuild_records(spark, path).collect()) == 1
    none = pages.limit(0)
    path = shared_dir(spark)
    warc.write_archive(none, path)
    assert html_text.extract(none).count() == warc.read_archive(spark, path).count() == warc.rebuild_records(spark, path).count() == 0


def test_busy_payloads_are_dealt_over_parts(spark, monkeypatch):
    rows = [(i, f"u{i}", ("a" * 1500, "", "b" * 20)[i % 3]) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def records():
        path = shared_dir(spark)
        warc.write_archive(pages, path)
        return sorted(map(tuple, warc.read_archive(spark, path).collect())), sorted((r.page_id, bytes(r.record)) for r in warc.rebuild_records(spark, path).collect())

    whole = records()
    monkeypatch.setattr(warc, "BUSY", 4)
    assert records() == whole and sum(r[3] == "revisit" for r in whole[0]) == 19


def test_bad_payloads_are_refused(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 2000)], "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("sha256", F.sha2(F.lit(b"other"), 256)).collect()
    spark.createDataFrame(bad, warc.STORED_DDL).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="doesn't have its digest"):
        spark.read.parquet(f"{path}/payloads").select("sha256", "block").mapInArrow(warc._prove, "sha256 string, real_sha1 string, real_bytes long").collect()


def test_captures(spark):
    t = lambda s: f"timestamp'{s}'"
    entries = spark.sql(f"SELECT * FROM VALUES ('com','block',{t('2024-01-10')}), ('a.com','allow',{t('2024-02-01')}) AS e(domain, action, listed_at)").withColumn("slice", F.lit("s"))
    rows = [(i, f"http://{h}.com/{i}", f"2024-{1 + i % 3:02d}-15 00:00:00") for i in range(40) for h in ("a", "b")] + [(1, None, None), (None, "http://a.com/", None), (3, "nothing", "2024-02-01 00:00:00")]
    captures = spark.createDataFrame(rows, "page_id long, url string, f string").withColumn("fetched_at", F.to_timestamp("f")).withColumn("domain", F.lit("d")).withColumn("_part", F.lit(9))
    judge = lambda **k: sorted((str(r.page_id), str(r.url), str(r.fetched_at), r.n_active, str(r.rule), r.blocked) for r in url_filter.filter_urls(captures, entries, **k).collect())
    whole = judge()
    assert len(whole) == len(rows) and judge(busy=3) == whole and judge(slice_days=400) == whole
    assert sum(r[5] for r in whole) == 40 + 14 and {r[4] for r in whole} == {"com", "a.com", "None"}
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert all(not r.blocked and r.n_active == 0 for r in url_filter.filter_urls(captures, entries.limit(0)).collect())
