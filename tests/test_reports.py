import random

from lexstrata.operators import graph, reports
from lexstrata.plans import queries
from lexstrata.sources import ingest


def test_subject_of(spark):
    rows = spark.createDataFrame([("Cricket history",), ("The WAR",), ("toward",), ("",), (None,)], "t string")
    got = [r.s for r in rows.select(reports.subject_of(rows.t).alias("s")).collect()]
    assert got == ["sports", "history", "", "", ""]


def test_subject_mix_reads_whole_texts(spark, tmp_path):
    """Subjects told by a text's start, middle and end all count, however long it is, beside those told by title and subtopic."""
    words = "alfa " * 4000
    texts = (f"The orchestra's film. {words}", f"{words} a cathedral and a church {words}", f"{words} a hospital", words, "")
    # Ids to which the corpus adds no words of a subject.
    ids = [i for i in range(140) if i % 7 > 4]
    rows = [(i, texts[k % 5], "en", "src1", len(texts[k % 5])) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.told_by, r.subject): (r.documents, r.share) for r in queries.subject_mix(spark, str(tmp_path)).collect()}
    coded = sum(i % 10 == 7 for i in ids)
    assert len(ids) == 40 and got == {
        ("text", "arts, language, and culture"): (8, 0.2), ("text", "religion"): (8, 0.2), ("text", "health"): (8, 0.2), ("title", "science and technology"): (coded, coded / 40),
    }


def test_corpus_lines_rank_subjects_of_texts(spark):
    """Each subject that texts tell of has a line, beside the three largest and the thin ones of titles."""
    names = [name for name, _ in reports.SUBJECTS]
    rows = [("Wikipedia", "India", "history", name) for k, name in enumerate(names) for _ in range(20 - k)] + [("uploads", "", "", ""), ("uploads", "", "", None)]
    nodes = spark.createDataFrame(rows, "collection string, topic string, subject string, text_subject string")
    got = [tuple(r) for r in reports.corpus_lines(nodes).collect()]
    assert sorted(r[1:] for r in got if r[0] == "text_subject") == sorted((name, 20 - k, k + 1) for k, name in enumerate(names))
    assert [r for r in got if r[0] in ("subject", "thin")] == [("subject", "history", len(rows) - 2, 1)]


def test_subject_bounds_are_ascii(spark):
    rows = spark.createDataFrame([("The écwar",), ("éwar",), ("WAR.",), ("warß",), ("_war",), (None,)], "t string")
    assert [r.s for r in rows.select(reports.subject_of(rows.t).alias("s")).collect()] == ["", "history", "history", "history", "", ""]


def test_year_span(spark):
    rows = spark.createDataFrame([(2001,), (2001,), (2003,), (2003,), (0,), (None,)], "year int")
    assert tuple(reports.year_span(rows).first()) == (4, 2001, 2003, 2001, 0.5, False)
    assert tuple(reports.year_span(rows.where("year = 0")).first()) == (0, None, None, None, None, False)


def test_cohorts(spark):
    rows = [(i, "t", 2010 + i % 2 * 10, f"{2010 + i % 2 * 10}-01-01", [1.0, float(i % 2)], *[0.1 + 0.1 * (i % 2)] * 8) for i in range(12)]
    columns = "id long, topic string, year int, date string, embedding array<double>, " + ", ".join(f"{c} double" for _, c, _ in reports.TRAITS if c != "_far")
    docs = spark.createDataFrame(rows + [(99, None, None, None, None, *[None] * 8)], columns)
    got = {r.trait: r for r in reports.cohort_traits(docs, least=10, size=3).collect()}
    assert len(got) == 9 and got["p_ai"].ai_like and not got["burstiness"].ai_like
    assert got["pre2019_centroid_distance"].before == 0 and round(got["pre2019_centroid_distance"].after, 4) == 0.2929
    assert reports.cohort_traits(docs, least=100).count() == 0


def test_merge_breakdown(spark):
    rows = spark.createDataFrame([("a", 1, 0.2, 0.1, 0.3), ("a", 3, 0.6, 0.5, 0.9), ("a", 5, None, None, None), ("b", 2, None, None, None), ("", 1, 0.5, 0.5, 0.5), (None, 1, 0.5, 0.5, 0.5)], "key string, documents long, mean double, low double, high double")
    assert sorted(map(tuple, reports.merge_breakdown(rows).collect())) == [("a", 9, 0.5, 0.1, 0.9), ("b", 2, None, None, None)]


def test_prune_edges_is_one_sorted_run(spark):
    rng = random.Random(5)
    for n in (8, 60):
        pairs = [(a, b, round(rng.uniform(0.3, 0.9), 1)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.15]
        edges = spark.createDataFrame(pairs, "src long, dst long, cosine double")
        best, degree, want = {}, {}, []
        for a, b, c in pairs:
            key = (min(a, b), max(a, b))
            best[key] = max(c, best.get(key, 0))
        for (a, b), c in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if max(degree.get(a, 0), degree.get(b, 0)) < (2 if n > 20 else 3) and (n <= 12 or c >= 0.45):
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                want.append((a, b, c))
        assert sorted(map(tuple, graph.prune_edges(edges, n).collect())) == sorted(want)


def test_payload_aliases(spark):
    payload = '{"query": {"normalized": [{"from": "x", "to": "A"}, {"from": "x", "to": "B"}], "redirects": [{"from": "y", "to": "C"}], "pages": [{"title": "A", "extract": "a"}, {"title": "B", "extract": "b"}, {"title": "C", "extract": " "}, {"extract": "z"}]}}'
    rows = spark.createDataFrame([(payload,), ("{",), (None,), ('{"query": {}}',)], "value string")
    assert sorted(map(tuple, ingest.article_extracts(rows).collect())) == [("A", "a"), ("B", "b"), ("x", "b")]
