"""Benchmark decontamination by pigeonhole edit matching.

Each test item is cut into one piece more than its error budget, so an occurrence
within the budget has at least one piece unchanged. Pieces are found exactly by one
automaton; each hit is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import digest_of, fresh, keys_for_join
from .storage import materialize

#: Characters of an item for each edit of its budget.
CHARS_PER_EDIT = 16
#: Items shorter than this (normalised) are matched together with their word bounds.
MIN_CHARS = 40
#: Bytes of items in one automaton; a larger benchmark is matched in several passes.
PASS_BYTES = 4 << 20
#: Letters of scripts written without spaces: Thai to Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_GAP = re.compile(r"[^\w]+", re.UNICODE)
DDL = "doc_id long, key binary, item_ids array<long>, distances array<int>, n_hits int"


def normalise(text: str | None) -> str:
    """Lower case, with one space for each run of anything but letters, digits and underscores."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget_of(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(item) // chars_per_edit


def bounded(item: str) -> str:
    """A short item with a space at each end, where a word must end there; scripts written without spaces have no such bounds."""
    if len(item) >= MIN_CHARS:
        return item
    return ("" if _UNSPACED.match(item[0]) else " ") + item + ("" if _UNSPACED.match(item[-1]) else " ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length, each with its offset."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, errors: int) -> int | None:
    """Least edit distance of ``pattern`` to any substring of ``text``; None if over ``errors``."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best if best <= errors else None


class Matcher:
    """The pieces of a set of normalised items, and verification of their hits."""

    def __init__(self, items: dict[tuple[int, int], str], chars_per_edit: int = CHARS_PER_EDIT):
        self.items = {i: bounded(t) for i, t in items.items()}
        self.errors = {i: budget_of(t, chars_per_edit) for i, t in items.items()}
        places: dict[str, list[tuple[tuple[int, int], int]]] = {}
        for i, t in self.items.items():
            for offset, piece in pieces(t, self.errors[i]):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Ids of items with a text within its budget of a substring of ``text``: their least distances."""
        text = f" {text} "
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if not len(self.automaton):
            return {}
        for end, (n, where) in self.automaton.iter(text):
            for item, offset in where:
                k = self.errors[item]
                start = end - n + 1 - offset - k
                spans.setdefault(item, []).append((start, start + len(self.items[item]) + 2 * k))
        found: dict[int, int] = {}
        for item, hits in spans.items():
            pattern, k = self.items[item], self.errors[item]
            if pattern in text:
                found[item[0]] = 0
                continue
            hits.sort()
            best, at, to = None, *hits[0]
            for start, stop in [*hits[1:], (1 << 62, 1 << 62)]:
                if start <= to - len(pattern) // 2:
                    to = max(to, stop)
                    continue
                d = myers(pattern, text[max(0, at) : to], k)
                if d is not None and (best is None or d < best):
                    best = d
                at, to = start, stop
            if best is not None:
                found[item[0]] = min(best, found.get(item[0], best))
        return found


def _passes(benchmark: DataFrame) -> Iterator[dict[tuple[int, int], str]]:
    """Normalised items by (item_id, number) in runs of about ``PASS_BYTES``, all texts of an id in one; streamed, so the driver holds one run."""
    run: dict[tuple[int, int], str] = {}
    size = 0
    rows = benchmark.where("item_id IS NOT NULL").groupBy("item_id", "text").count().orderBy("item_id", "text").select("item_id", "text")
    last = None
    for item_id, text in rows.toLocalIterator():
        item = normalise(text)
        if not item:
            continue
        if size + len(item) > PASS_BYTES and run and item_id != last:
            yield run
            run, size = {}, 0
        last = item_id
        run[item_id, len(run)] = item
        size += len(item)
    yield run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, item_ids (sorted), distances, n_hits, contaminated, for every row of ``docs``.

    An item is found if its normalised text is within len // chars_per_edit edits of a
    substring of the normalised document. Null and empty texts hold nothing; null and
    empty items and null item ids are not looked for; items under MIN_CHARS are matched with
    their word bounds, an edit of a bound counting as one; an item_id with several texts is found by
    any of them, at the least distance; repeated documents are each matched; an empty benchmark
    matches nothing.
    """
    return _matched(docs, benchmark, chars_per_edit).drop("key")


def _matched(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int) -> DataFrame:
    """The verdicts with the digest of each text as key."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), digest_of(F.col("text")).alias("key"), "text")
    parts = []
    for items in _passes(benchmark.select(F.col("item_id").cast("long"), "text")):
        shared = spark.sparkContext.broadcast((items, chars_per_edit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                ids, distances = [], []
                for text in batch.column(2):
                    found = sorted(matcher.find(normalise(text.as_py())).items())
                    ids.append([i for i, _ in found])
                    distances.append([d for _, d in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int32())],
                    names=["doc_id", "key", "item_ids", "distances", "n_hits"],
                )

        parts.append(docs.mapInArrow(run, DDL))
    whole = parts[0]
    if len(parts) > 1:
        # The passes differ in their items only; repeated rows are counted by the first pass.
        whole = reduce(DataFrame.unionByName, (p.withColumn("_pass", F.lit(k)) for k, p in enumerate(parts)))
        whole = whole.groupBy("doc_id", "key").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_ids", "distances"))))).alias("hits"), F.count_if(F.col("_pass") == 0).alias("_copies")
        ).select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
        whole = whole.withColumns({"item_ids": F.col("hits.item_ids"), "distances": F.col("hits.distances"), "n_hits": F.size("hits")})
    return whole.select("doc_id", "item_ids", "distances", "n_hits", (F.col("n_hits") > 0).alias("contaminated"), "key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged; the verdict is met by the text's digest."""
    key = fresh(docs, "_key")
    bad = _matched(docs, benchmark, CHARS_PER_EDIT).where("contaminated").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, digest_of(F.col("text"))).join(keys_for_join(materialize(bad, "contaminated")), key, "left_anti").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark)
