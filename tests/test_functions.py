import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lexstrata.functions import html, naming, urls
from lexstrata.functions import kernels
from lexstrata.functions.embed import cosine
from lexstrata.functions.text import query_tokens, style_features, year_of_date
from lexstrata.operators import score, views
from lexstrata.operators.catalog import set_dates
from lexstrata.sources import ingest
from lexstrata.streaming.microbatch import append_features


def test_years(spark):
    got = [r[0] for r in spark.createDataFrame([("2021-03-04",), ("12 Mar 2021",), ("3000 or 1999",), ("12345",), ("",), (None,)], "d string").select(year_of_date(F.coalesce("d", F.lit("")))).collect()]
    assert got == [2021, 2021, 1999, 0, 0, 0]


def test_style_known_answer(spark):
    r = style_features(spark.createDataFrame([("One two. Three four five! It's",), (None,), ("",)], "text string")).collect()
    assert (r[0].word_count, r[0].type_token_ratio, r[0].avg_sentence_length, r[0].sentence_length_std) == (6, 1.0, 2.0, 1.0)
    assert all(x.word_count == 0 and x.burstiness == 0 and x.punctuation_ratio == 0 for x in r[1:])


def test_urls(spark):
    rows = ["HTTP://Www.A.com.:80//x//y/", "a.com", "//b.org?q=1", "ftp://x", "", "https://10.1.2.3/", "http://h:99/", None]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "u string").select(urls.normalize_url(F.col("u")), urls.is_public(F.col("u"))).collect()]
    assert got == [
        ("http://www.a.com/x/y", True), ("https://a.com/", True), ("https://b.org/?q=1", True), (None, False), (None, False), ("https://10.1.2.3/", False), ("http://h:99/", True), (None, False),
    ]


def plain_style(text):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    w = re.findall(rb"[a-z0-9']+", low)
    lengths = [len(re.findall(rb"[a-z0-9']+", s)) for s in re.split(rb"(?<=[.!?])[ \t\n\x0b\f\r]+", low.strip(b" \t\n\x0b\f\r"))]
    lengths = [n for n in lengths if n]
    mean = sum(lengths) / len(lengths) if lengths else 0.0
    sd = math.sqrt(sum((n - mean) ** 2 for n in lengths) / (len(lengths) - 1)) if len(lengths) > 1 else 0.0
    grams = list(zip(w, w[1:], w[2:]))
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())
    marks = len(re.findall(rb"[.,;:!?\"'()-]", raw))
    return (
        len(w), len(set(w)) / len(w) if w else 0.0, mean, sd, sd / mean if mean else 0.0, marks / len(raw) if raw else 0.0,
        (len(grams) - len(set(grams))) / len(grams) if len(w) >= 6 else 0.0, entropy,
    )


def plain_embedding(text, dim=128):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)

    def slot(token):
        h = 0
        for c in token:
            h = (31 * h + c) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % dim

    out = [0.0] * dim
    if raw.strip(b" \t\n\x0b\f\r"):
        for t in re.findall(rb"[a-z0-9]{2,}", low):
            out[slot(t)] += 1
            out[slot(t + b"#2")] += 0.5
        for c in raw[::7]:
            out[(c - 256 if c > 127 else c) % dim] += 0.05
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else 0.0 for x in out]


def test_kernels_match_plain_code(monkeypatch):
    rng = random.Random(4)
    alphabet = "aB9' .!?\n,éß字-\t"
    texts = [None, "", " ", "a", "One two. Three four five! It's", "x" * 9, "It's a. b?c! d.\n e", "." * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for size in (1 << 20, 64):
        monkeypatch.setattr(kernels, "RUN_BYTES", size)
        style, vectors = kernels.style(pa.array(texts)).to_pylist(), kernels.embed(pa.array(texts), 128).to_pylist()
        for t, s, v in zip(texts, style, vectors):
            assert all(abs(a - b) < 1e-9 for a, b in zip(s.values(), plain_style(t))), t
            assert all(abs(a - b) < 1e-12 for a, b in zip(v, plain_embedding(t))), t
    assert kernels.style(pa.array([], pa.string())).to_pylist() == [] and kernels.embed(pa.array([], pa.string()), 128).to_pylist() == []


def test_embedding_edges(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>").select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()
    assert [x[0] for x in r] == [0.0, 1.0, 0.0]


def test_fractional_rank(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.3), (1, 0.3), (1, 0.9), (2, 0.5)], "g int, v double")
    assert sorted(r.r for r in score.fractional_rank(rows, ["g"], "v", "r").collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]


def test_view_scope(spark):
    docs = spark.createDataFrame([(1, 1, "usa", "a", "s"), (2, 4, "India", "b", "s"), (3, 2, " india ", "c", "s"), (4, 2, "other_thing", "d", "s"), (5, 9, "India", "e", "s"), (6, 2, "", "Rivers in India", "s")], "id long, dataset_id int, topic string, title string, source string")
    sets = spark.createDataFrame([(1, "Wikipedia", "WIKIPEDIA_SAMPLE"), (2, "GDELT", "GDELT"), (4, "x", "WIKIPEDIA_SUBSET")], "dataset_id int, name string, kind string")
    got = {r.id: (r.topic, r.subtopic) for r in views.view(docs, sets).collect()}
    assert got == {1: ("United States", ""), 3: ("India", ""), 4: ("", "Other Thing"), 6: ("India", "")}
    assert sorted(r.id for r in views.view(docs, sets, topic=" INDIA ").collect()) == [3, 6]
    assert [r.id for r in views.view(docs, sets, topic="General").collect()] == [4]
    assert [r.id for r in views.view(docs, sets, topic="USA", ids=docs.where("id < 3").select("id")).collect()] == [1]
    assert [r.id for r in views.view(docs, sets, dataset_id=4).collect()] == [2]
    assert query_tokens("Is it a big-Cat?") == ["big", "cat"]


def test_scores_without_vectors(spark):
    rows = [(i, 1, "t", f"{2012 + i}-01-01", None, "Some text here. " * (i + 1)) for i in range(12)]
    docs = score.featured(spark.createDataFrame(rows, "id long, dataset_id int, title string, created_at string, published_at string, text string"))
    odd = docs.withColumn("embedding", F.when(F.col("id") % 3 > 0, F.col("embedding")))
    got = {r.id: r for r in score.era_scores(odd).collect()}
    assert len(got) == 12 and got[9].distance == 0.5 and got[0].band == "LIKELY_HUMAN" and all(r.p_ai is not None for r in got.values())
    none = score.era_scores(odd.withColumn("embedding", F.lit(None).cast("array<double>"))).collect()
    assert all(not r.have_pre and r.distance == 0.5 for r in none)
    assert score.era_scores(docs.limit(0)).count() == 0
    stored = docs.join(score.era_scores(docs).select("id", *score.STORED), "id")
    kept = {r.id: r.p_ai for r in score.era_scores(stored.where("year >= 2019"), keep_stored=True).collect()}
    assert kept == {r.id: r.p_ai for r in stored.where("year >= 2019").collect()}


def test_set_dates(spark):
    docs = spark.createDataFrame([(1, "A b", None), (2, "c", "2001"), (3, "zz", None)], "id int, title string, created_at string")
    dates = spark.createDataFrame([("a B", "2010"), ("c", "2011")], "title string, date string")
    assert {r.id: r.created_at for r in set_dates(docs, dates).collect()} == {1: "2010", 2: "2001", 3: None}
    assert {r.id: r.created_at for r in set_dates(docs, dates, overwrite=True).collect()} == {1: "2010", 2: "2011", 3: None}


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("  The software works. ")
    (tmp_path / "in/b.jsonl").write_text('{"title": "T", "text": "some text"}\n\nnot json\n{"title": "U", "text": "  "}\n')
    (tmp_path / "in/e.html").write_text("<title>Page one</title><p>Body <b>words</b></p><script>x</script>")
    stream = zlib.compress(b"BT (Hello \\(pdf\\)) Tj (two\\051) Tj ET")
    (tmp_path / "in/f.pdf").write_bytes(b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\n")
    (tmp_path / "in/g.zip").write_bytes(b"not a zip")
    with zipfile.ZipFile(io.FileIO(tmp_path / "in/c.zip", "w"), "w") as z:
        z.writestr("dir/d.txt", "zipped words here")
        z.writestr("empty.txt", " ")
    got = sorted((r.title, r.text, r.topic, r.source, r.word_count) for r in ingest.read_uploads(spark, str(tmp_path / "in")).collect())
    # The file's own bytes are scanned as well as its inflated stream.
    assert got[-1][0] == "f" and got[-1][1].endswith("Hello (pdf) two)") and got[-1][3] == "f.pdf"
    assert got[:-1] == [
        ("Page one", "Page one Body words", "general", "e.html", 4), ("T", "some text", "general", "b.jsonl", 2), ("a", "The software works.", "computer_science", "a.txt", 3),
        ("d", "zipped words here", "general", "d.txt", 3),
    ]
    sets = spark.createDataFrame([(4, "A-B", "USER_UPLOAD", "2024")], "dataset_id long, name string, kind string, created_at string")
    row, documents = ingest.ingest_uploads(spark, str(tmp_path / "in"), sets, "a-b (3)", "2025")
    assert tuple(row.first()) == (5, "a-b-2", "USER_UPLOAD", "2025") and documents.where("dataset_id = 5").count() == 5
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.txt").write_text(" ")
    with pytest.raises(ValueError, match="no extractable"):
        ingest.ingest_uploads(spark, str(tmp_path / "none"), sets, "", "2025")


def test_micro_batches_compute_what_is_missing(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    rows = lambda ids: spark.createDataFrame([(i, "t", f"Some text {i}. More.", "2015-01-01", None) for i in ids], "id long, title string, text string, created_at string, published_at string")
    rows([1, 2]).write.parquet(str(src))
    seen = []
    schema = spark.read.parquet(str(src)).schema
    run = lambda: append_features(spark.readStream.schema(schema).parquet(str(src)), out, str(tmp_path / "ck"), lambda t: seen.append(t.count())).awaitTermination(120)
    run()
    rows([2, 3, 3]).write.mode("append").parquet(str(src))
    run()
    table = spark.read.parquet(out)
    assert seen == [2, 3] and sorted((r.id, r.year, len(r.embedding)) for r in table.collect()) == [(1, 2015, 128), (2, 2015, 128), (3, 2015, 128)] and "text" not in table.columns


def test_pages():
    page = html.parse_page(
        '<html><head><title>A &amp; B</title><meta property="article:published_time" content="2020-02-03T00:00"><style>x</style></head><body><div id="mw-content-text">Main<p>text<sup class="reference">[1]</sup>'
        '</div><table class="infobox big"><tr><td>skip</table><time datetime="2019-01-01">d</time><a href="/x?a=1&amp;b=2">l</a><!-- <a href="no"> --><a href=y>m</a>'
        '<div id="mw-normal-catlinks"><a href="/c">Cats &gt; dogs</a></div><li id="footer-info-lastmod">This page was last edited on 5 March 2021</li></body>'
    )
    assert (page.title, page.wiki_text, page.modified, page.time, page.hrefs, page.categories) == ("A & B", "Main text", "2020-02-03T00:00", "2019-01-01", ["/x?a=1&b=2", "y", "/c"], ["Cats > dogs"])
    assert page.body.startswith("A & B Main text d") and "skip" not in page.body and "[1]" not in page.body and page.footer == "This page was last edited on 5 March 2021"
    assert html.unescape("&lt;&#65;&#x42;&copy;&nbsp;&#70000;&toolongname;&amp") == "<AB&copy;  &toolongname;&amp"
    empty = html.parse_page("")
    assert empty.title == empty.body == empty.footer == "" and html.parse_page("a < b").body == "a"


def test_links(spark):
    rows = spark.createDataFrame([("https://en.wikipedia.org/wiki/A", ["/wiki/B", "/wiki/B#x", "/wiki/A", "/wiki/Talk:C", "https://de.wikipedia.org/wiki/D", "/w/e", None]), ("http://blog.gdeltproject.org/", ["/a", "b.pdf", "http://x.org/", "/"])], "u string, h array<string>")
    got = [tuple(r) for r in rows.select(html.article_links(F.col("u"), F.col("h")), html.project_links(F.col("u"), F.col("h")), html.same_host_links(F.col("u"), F.col("h"))).collect()]
    assert got[0][0] == ["https://en.wikipedia.org/wiki/B", "https://en.wikipedia.org/wiki/B#x"] and got[0][1] == []
    assert got[1][1] == got[1][2] == ["http://blog.gdeltproject.org/a"]
    page = rows.limit(1).select(F.struct(F.lit("none").alias("footer"), F.lit("").alias("modified"), F.lit(" 2020-01-02T3").alias("time")).alias("p"))
    assert page.select(html.published(F.col("p"), F.lit("2021-01-01")).alias("d")).first().d == "2020-01-02"


def test_names():
    assert naming.display_name("  My   set (12) ") == "My set" and naming.token(" A_b  C! (3)") == "a-b-c" and naming.file_name("x\\y/Report v2.final.pdf") == "report-v2-final"
    assert naming.address_name("www.fooproject.org.", "/index.html/wiki/Big_Cats.html") == "foo-big-cats" and naming.host_name("") == "url" and naming.path_name("/pages/") == ""
    assert naming.upload_name("", ["a.txt", "A.pdf", "b.txt"]) == "a-b" and naming.upload_name(None, []) == "upload"
    assert naming.free_name("x", "USER_URLS", {"x", "x-2"}.__contains__, "now") == "x-3" and naming.free_name(" ", "USER_URLS", lambda n: False, "") == "url"
    assert naming.free_name("x", "", lambda n: True, "now") == "x-now"
