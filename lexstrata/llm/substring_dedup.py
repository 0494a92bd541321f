"""Substring dedup by level-wise doubling over word windows.

Short windows repeated nowhere end at the first level. A window of twice the length (the target's
at most) is built only where both its halves survived, and so on until the target's length or until
no window survives. At the first two lengths winnowing picks which short windows are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .native import digest_of, fresh
from .rolling import U, blocks, mix, prefix_sums, span_hash, window_hash
from .storage import materialize

WINDOW = 35
#: Greatest length of the first level's windows.
BASE = 5


def levels(window: int, base: int | None = None) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``window``."""
    base = base or BASE
    out = [window]
    while out[0] > base:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _send_windows(plan: R.Plan, shards: int, survivors: bool):
    def blobs(held: list[tuple[np.ndarray, ...]]) -> list[tuple[int, int, bytes]]:
        """Runs (tid, start, n, least k-gram, both hashes of all their windows): runs that repeat here are settled, of equal ones one is sent."""
        tid, start, n, least, a, b = (np.concatenate([x[i] for x in held]) for i in range(6))
        at = np.cumsum(n) - n
        # A run is named by its windows: two hashes over theirs, in order.
        one, two = (span_hash(prefix_sums(x, k), at, at + n, k) for k, x in enumerate((a, b)))
        order = np.lexsort((two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        name = np.empty(len(order), dtype=np.int64)
        name[order] = np.cumsum(new) - 1
        again = np.bincount(name)[name] > 1
        out = list(R.to_texts(tid[again], start[again], n[again]))
        first = np.unique(name, return_index=True)[1]
        for s, part in R.groups((least[first] % U(shards)).astype(np.int64)):
            k = first[part]
            w = R.ranges(at[k], n[k])
            out.append((0, s, R.pack(tid[k], start[k], n[k], a[w], (b[w] >> U(32)).astype(np.uint32))))
        return out

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places, out, held, size = R.gathered(found), [], [], 0
        if texts.num_rows and places:
            tids = texts.column("tid").to_numpy()
            for block in blocks(texts.column("text")):
                runs = R.candidate_runs(plan, block, tids[block.rows], places, survivors)
                if runs is None:
                    continue
                w = R.ranges(runs.at, runs.n)
                a, b = window_hash(runs.codes, plan.window)[w], window_hash(mix(runs.codes + U(1)), plan.window, 1)[w]
                held.append((tids[block.rows][runs.row], runs.start.astype(np.int32), runs.n.astype(np.int32), runs.least, a, b))
                size += len(w)
                if size >= R.HELD:
                    out += blobs(held)
                    held, size = [], 0
        if held:
            out += blobs(held)
        return pa.Table.from_batches([R._batch(out)])

    return run


def _settle_windows(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of windows that occur at two places or more."""
    parts = [R.unpack(b) for b in blobs]
    tid, start, n, a, b = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    twice = np.zeros(len(a), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    yield from R.to_texts(*runs_of(twice, tid, start, n))


def runs_of(flag: np.ndarray, tid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged windows: tid, start, number."""
    run = np.repeat(np.arange(len(n)), n)
    offset = R.ranges(np.zeros(len(n), dtype=np.int64), n)
    hit = np.flatnonzero(flag)
    if not len(hit):
        return tid[:0], start[:0], n[:0]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(run[hit]) != 0)
    begin = np.flatnonzero(new)
    first = hit[begin]
    return tid[run[first]], (start[run[first]] + offset[first]).astype(np.int32), np.diff(begin, append=len(hit)).astype(np.int32)


DDL = "digest binary, n_words long, n_removed long, kept_sha256 string, kept string"
_OUT = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cut(text: bytes, gone: np.ndarray) -> str:
    """The text without the flagged words and the white space behind each."""
    spans, at = [], 0
    for w in text.split():
        begin = text.index(w, at)
        at = begin + len(w)
        spans.append(begin)
    spans.append(len(text))
    keep = [text[: spans[0]]] + [text[spans[i] : spans[i + 1]] for i in np.flatnonzero(~gone)]
    return b"".join(keep).decode("utf-8")


def _finish(window: int, with_text: bool):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = R.gathered(found) or [np.empty(0, np.int64)] * 3
        rows = []
        for digest, copies, tid, text in zip(*(texts.column(c).to_pylist() for c in ("digest", "copies", "tid", "text"))):
            raw = text.encode("utf-8")
            words = raw.split()
            lo, hi = np.searchsorted(places[0], tid), np.searchsorted(places[0], tid, side="right")
            if copies > 1 and len(words) >= window:
                gone = np.ones(len(words), dtype=bool)
            elif hi > lo:
                gone = R.covered(len(words), places[1][lo:hi], places[2][lo:hi], window)
            else:
                gone = np.zeros(len(words), dtype=bool)
            removed = int(gone.sum())
            kept = [words[i] for i in np.flatnonzero(~gone)] if removed else words
            rows.append((digest, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), _cut(raw, gone) if with_text and removed else None))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    return run


def judged(docs: DataFrame, *, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """digest of each distinct text, n_words, n_removed, kept_sha256, kept (the cut text where words go; else null)."""
    steps = levels(window)
    texts, folder = R.prepare(docs)
    found = None
    for gram, size in zip(steps, steps[1:] or [window]):
        plan = R.Plan("word", size, min(gram, size))
        survivors = found is not None
        if not survivors:
            found = materialize(R.repeated_anchors(texts, plan), "anchors", folder)
        sent = R.with_texts(texts.select("p", "tid", "text"), found, _send_windows(plan, R.shards_of(texts), survivors), R.ROUTED)
        found = R.dealt(sent).mapInArrow(lambda it: R.by_shard(it, _settle_windows), R.ROUTED)
        found = materialize(found, f"windows_{size}", folder)
        if found.isEmpty():
            break
        if size < window:
            found = found.mapInArrow(_starts, R.ROUTED)
    return R.with_texts(texts.select("p", "digest", "copies", "tid", "text"), found, _finish(window, with_text), DDL)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows as the single places of the next level's grams."""
    for batch in batches:
        out = []
        for kind, shard, blob in zip(*(c.to_pylist() for c in batch.columns)):
            tid, start, n = R.unpack(blob)
            out.append((kind, shard, R.pack(np.repeat(tid, n), R.ranges(start.astype(np.int64), n).astype(np.int32))))
        yield R._batch(out)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A word goes if a window of ``window`` words that covers it has the same words as a window
    that starts anywhere else in the table; all such windows count, the first included. Null
    and empty texts have no words; repeated rows are copies of each other; texts under
    ``window`` words lose nothing; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    return keyed.join(judged(docs, window=window), "digest").select("doc_id", "n_words", "n_removed", "kept_sha256")


def cut_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of text (and n_chars counted again, if there); texts left without words go."""
    key, kept = fresh(docs, "_digest"), fresh(docs, "_kept")
    changed = judged(docs, window=window, with_text=True).where("n_removed > 0").select(F.col("digest").alias(key), F.col("kept").alias(kept))
    joined = docs.withColumn(key, digest_of(F.col("text"))).join(changed, key, "left")
    text = F.coalesce(kept, "text")
    rows = joined.where(F.col(kept).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]")).withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM again, range(35) t(j)),
one AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
