"""Evidence for a question by an inverted index: postings sorted by term, a vocabulary, and stored scores.

A question's word counts where it lies within a term of a document's title, topic, address or source, so words are first met
with the vocabulary, which grows with the different terms alone, and then with the postings of the terms found. A document's stored
score is kept with its postings: ranking reads no document, and fills up with unmatched ones by that score only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import ascii_lower, query_tokens
from lexstrata.storage import materialize

FIELDS = ("title", "topic", "url", "source")
#: What a question's word adds; stored scores add less than that in all, so that matched documents come first.
HIT = 4.0
#: Terms that scans are told to look for; more are joined.
LISTED = 200


@dataclass(frozen=True)
class Index:
    """postings: (term, field, place, id); vocabulary: (term, documents); stored: (id, stored, band)."""

    postings: DataFrame
    vocabulary: DataFrame
    stored: DataFrame


def stored_score() -> Column:
    """A document's part of the rank that no question changes: distance of its score from even odds, and its band."""
    return F.coalesce(F.abs(F.col("p_ai") - 0.5) * 2, F.lit(0.0)) + F.when(F.col("band") == "LIKELY_AI", 0.5).otherwise(0.0)


def postings(docs: DataFrame) -> DataFrame:
    """(term, field, place, id, stored, band) of each blank-separated term; null fields have none. In order of terms, which scans skip by."""
    terms = lambda c: F.filter(F.transform(F.split(ascii_lower(F.coalesce(F.col(c), F.lit(""))), " "), lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("field"), i.alias("place"))), lambda x: x["term"] != "")
    rows = docs.select("id", stored_score().alias("stored"), "band", F.explode(F.flatten(F.array(*map(terms, FIELDS)))).alias("p"))
    return rows.select("p.*", "id", "stored", "band").repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def vocabulary(posted: DataFrame) -> DataFrame:
    """(term, documents) of all terms."""
    return posted.groupBy("term").agg(F.count_distinct("id").alias("documents"))


def stored(docs: DataFrame) -> DataFrame:
    return docs.select("id", stored_score().alias("stored"), "band")


def search(index: Index, question: str, limit: int = 8) -> DataFrame:
    """(id, score, band): the ``limit`` best by 4 for each of the question's words that a document has, and its stored score; ties by id.

    A word given twice counts twice. A question without words ranks by stored scores.
    """
    spark = index.postings.sparkSession
    words = Counter(query_tokens(question))
    stored_only = index.stored.select("id", F.round("stored", 6).alias("score"), "band")
    if not words:
        return stored_only.orderBy(F.desc("score"), "id").limit(limit)
    asked = F.broadcast(spark.createDataFrame(list(words.items()), "word string, times long"))
    terms = materialize(index.vocabulary.join(asked, F.col("term").contains(F.col("word"))).select("term", "word", "times"), "terms")
    some = [r.term for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    found = index.postings.where(F.col("term").isin(some)) if len(some) <= LISTED else index.postings
    hits = found.join(terms, "term").select("id", "word", "times", "stored", "band").groupBy("id", "word").agg(F.first("times").alias("times"), F.first("stored").alias("stored"), F.first("band").alias("band"))
    ranked = hits.groupBy("id").agg(F.round(HIT * F.sum("times") + F.first("stored"), 6).alias("score"), F.first("band").alias("band"))
    best = materialize(ranked.orderBy(F.desc("score"), "id").limit(limit), "best")
    if best.count() == limit:
        return best
    rest = stored_only.join(F.broadcast(best.select("id")), "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit)
    return best.unionByName(rest).orderBy(F.desc("score"), "id").limit(limit)
