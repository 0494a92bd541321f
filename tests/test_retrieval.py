import pytest
from pyspark.sql import functions as F

from lexstrata.operators import retrieval, views

DDL = "id long, title string, topic string, url string, source string, p_ai double, band string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"Report {i} on Rivers" if i % 3 else None, ("India", "", None)[i % 3], f"http://site{i % 7}.example/a b", f"src{i % 11}", None if i % 13 == 0 else i % 10 / 10, ("LIKELY_AI", None, "UNCERTAIN")[i % 3], "t") for i in range(400)]
    return spark.createDataFrame(rows + rows[:3], DDL)


@pytest.fixture(scope="module")
def index(docs):
    posted = retrieval.postings(docs).cache()
    return retrieval.Index(posted, retrieval.vocabulary(posted), retrieval.stored(docs.dropDuplicates()))


@pytest.mark.parametrize("question", ("Which river reports of src7 in India?", "site3 site3 src1", "report 39", "nothingatall", "", "indi", "a"))
@pytest.mark.parametrize("limit", (3, 40))
def test_equals_a_scan(docs, index, question, limit, monkeypatch):
    """The same rows as reading every document, for words within terms, repeated words, few or no hits, and many terms."""
    want = [(r.id, r.score, r.band) for r in views.evidence(docs.dropDuplicates(), question, limit).collect()]
    assert [tuple(r) for r in retrieval.search(index, question, limit).collect()] == want
    monkeypatch.setattr(retrieval, "LISTED", 1)
    assert [tuple(r) for r in retrieval.search(index, question, limit).collect()] == want


def test_postings(index, docs):
    rows = index.postings.where("id = 7 AND field = 'title'").select("term", "place").orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("report", 0), ("7", 1), ("on", 2), ("rivers", 3)]
    assert index.vocabulary.where("term = 'india'").first().documents == docs.where("topic = 'India'").select("id").distinct().count()


def test_empty(spark, docs):
    none = retrieval.postings(docs.limit(0))
    assert retrieval.search(retrieval.Index(none, retrieval.vocabulary(none), retrieval.stored(docs.limit(0))), "india").count() == 0


def test_matched_documents_only(index):
    """Where enough documents match, the table of all documents' scores isn't read."""
    found = retrieval.search(retrieval.Index(index.postings, index.vocabulary, index.stored.where(F.raise_error(F.lit("read")).isNull())), "india", 5)
    assert found.count() == 5
