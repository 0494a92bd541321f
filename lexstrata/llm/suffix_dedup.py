"""Suffix-array dedup with a distributed difference-cover construction.

Windows whose anchors repeat are dealt to shards by their least k-gram, so all suffixes that
can agree on a whole window are in one shard. Each shard sorts its suffixes by difference
cover: sampled triples are sorted and named, the names are sorted by recursion, the remaining
suffixes are merged in, and adjacent suffixes are compared over the window's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .native import digest_of
from .rolling import U, blocks
from .storage import materialize
from .substring_dedup import runs_of

WINDOW = 100
GRAM = 50
#: Shards for each shuffle partition: a shard's suffix array is built in one Python worker.
SHARDS = 4


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys (none below 0), and the keys in it: where key and place fit into one number, by a plain sort."""
    bits = max(1, len(keys)).bit_length()
    if len(keys) and int(keys.max()) < 1 << (62 - bits):
        held = np.sort((keys << bits) | np.arange(len(keys)))
        return held & ((1 << bits) - 1), held >> bits
    order = np.argsort(keys)
    return order, keys[order]


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and the number of different keys."""
    order, ranked = _sorted(keys)
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def _triples(t: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    if top < (1 << 20):
        return (t[at] * top + t[at + 1]) * top + t[at + 2]
    pair, size = _names(t[at + 1] * top + t[at + 2])
    return t[at] * (size + 1) + pair


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (positive integers) in order, by difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), dtype=np.int64)
    t = np.zeros(n + 3, dtype=np.int64)
    t[:n] = text
    top = int(t.max()) + 1
    # Sample: places 1 and 2 modulo 3; the end counts as a place, so that the first class closes with a 0.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names, different = _names(_triples(t, sample, top))
    if different < len(sample):
        order = suffix_order(names)
        names = np.empty(len(sample), dtype=np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    width = len(sample) + 1
    real = np.empty(len(sample), dtype=np.int64)
    real[names - 1] = sample
    real = real[real < n]
    ones, twos, rest = real[real % 3 == 1], real[real % 3 == 2], np.arange(0, n, 3)
    # The rest in order: their keys beside the twos rise in that order too, so both searches run along.
    by, key = _sorted(t[rest] * width + rank[rest + 1])
    below = np.searchsorted(t[ones] * width + rank[ones + 1], key)
    pairs = np.concatenate([t[twos] * top + t[twos + 1], t[rest] * top + t[rest + 1]])
    if top * top * width >= 1 << 62:
        pairs, _ = _names(pairs)
    below += np.searchsorted(pairs[: len(twos)] * width + rank[twos + 2], (pairs[len(twos) :] * width + rank[rest + 2])[by])
    place = below + np.arange(len(rest))
    out = np.empty(n, dtype=np.int64)
    out[place] = rest[by]
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[free] = real
    return out


def equal_neighbours(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each start (but the first) has the same window as the one before it."""
    out = np.zeros(len(starts), dtype=bool)
    step = np.arange(window)
    for i in range(1, len(starts), 1 << 15):
        now, before = starts[i : i + (1 << 15)], starts[i - 1 : i - 1 + (1 << 15)][: len(starts[i : i + (1 << 15)])]
        near = np.flatnonzero((data[now] == data[before]) & (data[now + window - 1] == data[before + window - 1]) & (data[now + window // 2] == data[before + window // 2]))
        out[i + near] = (data[now[near, None] + step] == data[before[near, None] + step]).all(axis=1)
    return out


def _send_runs(plan: R.Plan, shards: int):
    def blobs(held: list[tuple]) -> list[tuple[int, int, bytes]]:
        """Runs (tid, order, start, n, least k-gram, two hashes, bytes): of equal ones the first is sent, the others are settled."""
        tid, order, start, n, least, one, two = (np.concatenate([x[i] for x in held]) for i in range(7))
        data = np.concatenate([x[7] for x in held])
        size = n.astype(np.int64) + plan.window - 1
        at = np.cumsum(size) - size
        by = np.lexsort((start, tid, order, two, one))
        first = np.ones(len(by), dtype=bool)
        first[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        late, kept = by[~first], np.sort(by[first])
        out = list(R.to_texts(tid[late], start[late], n[late]))
        for s, part in R.groups((least[kept] % U(shards)).astype(np.int64)):
            k = kept[part]
            out.append((0, s, R.pack(tid[k], order[k], start[k], n[k], data[R.ranges(at[k], size[k])])))
        return out

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places, out, held, total = R.gathered(found), [], [], 0
        if texts.num_rows and places:
            tids, ids = texts.column("tid").to_numpy(), texts.column("first_id").to_numpy()
            for block in blocks(texts.column("text")):
                runs = R.candidate_runs(plan, block, tids[block.rows], places)
                if runs is None:
                    continue
                one, two = R.run_names(plan, runs)
                data = block.data[R.ranges(runs.at, runs.n + plan.window - 1)]
                held.append((tids[block.rows][runs.row], ids[block.rows][runs.row], runs.start.astype(np.int32), runs.n.astype(np.int32), runs.least, one, two, data))
                total += len(data)
                if total >= R.HELD << 1:
                    out += blobs(held)
                    held, total = [], 0
        if held:
            out += blobs(held)
        return pa.Table.from_batches([R._batch(out)])

    return run


def _settle_suffixes(window: int):
    def settle(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """Runs of windows that also start earlier, from the suffix array of the shard's strings."""
        parts = [R.unpack(b) for b in blobs]
        tid, order, start, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        strings: list[bytes] = []
        for p in parts:
            at = np.concatenate([[0], np.cumsum(p[3].astype(np.int64) + window - 1)])
            raw = p[4].tobytes()
            strings += [raw[at[i] : at[i + 1]] for i in range(len(p[3]))]
        seen: dict[bytes, int] = {}
        late = np.zeros(len(tid), dtype=bool)
        by = np.lexsort((start, tid, order))
        for i in by:
            late[i] = seen.setdefault(strings[i], i) != i
        yield from R.to_texts(tid[late], start[late], n[late])
        # Strings lie in order of their documents and starts, so of equal windows the first is that of least place in ``data``.
        one = by[~late[by]]
        tid, order, start, n = tid[one], order[one], start[one], n[one]
        data = np.frombuffer(b"\x00".join(strings[i] for i in one), dtype=np.uint8)
        # Bytes from 2, separators 1: a string's end is below any byte, and windows never hold one.
        symbols = data.astype(np.int64) + 2
        length = n.astype(np.int64) + window - 1
        at = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        symbols[at[1:] - 1] = 1
        string = np.full(len(data), -1, dtype=np.int64)
        string[R.ranges(at, n.astype(np.int64))] = np.repeat(np.arange(len(n)), n)
        suffixes = suffix_order(symbols)
        suffixes = suffixes[string[suffixes] >= 0]
        new = np.flatnonzero(~equal_neighbours(data, suffixes, window))
        flag = np.zeros(len(data), dtype=bool)
        flag[suffixes] = True
        flag[np.minimum.reduceat(suffixes, new)] = False
        yield from R.to_texts(*runs_of(flag[R.ranges(at, n.astype(np.int64))], tid, start, n))

    return settle


DDL = "digest binary, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT = pa.schema([("digest", pa.binary()), ("first_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _finish(window: int):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = R.gathered(found) or [np.empty(0, np.int64)] * 3
        rows = []
        for digest, first_id, tid, text in zip(*(texts.column(c).to_pylist() for c in ("digest", "first_id", "tid", "text"))):
            raw = text.encode("utf-8")
            lo, hi = np.searchsorted(places[0], tid), np.searchsorted(places[0], tid, side="right")
            removed = spans = 0
            if hi > lo:
                gone = R.covered(len(raw), places[1][lo:hi], places[2][lo:hi], window)
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                raw = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            rows.append((digest, first_id, len(raw) + removed, removed, spans, hashlib.sha256(raw).hexdigest()))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    return run


def suffix_dedup(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a ``window``-byte string that covers it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Null texts are empty; a null id is smallest of
    all; rows that repeat an id and its text are one document, rows that repeat an id with
    other texts are ordered by storage; texts under ``window`` bytes lose nothing; an empty table
    gives no rows.
    """
    plan = R.Plan("byte", window, min(gram, window))
    texts, folder = R.prepare(docs)
    found = materialize(R.repeated_anchors(texts, plan), "anchors", folder)
    sent = R.with_texts(texts.select("p", "tid", "first_id", "text"), found, _send_runs(plan, SHARDS * R.shards_of(texts)), R.ROUTED)
    found = materialize(R.dealt(sent).mapInArrow(lambda it: R.by_shard(it, _settle_suffixes(window)), R.ROUTED), "suffixes", folder)
    each = R.with_texts(texts.select("p", "tid", "first_id", "digest", "text"), found, _finish(window), DDL)
    keyed = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(R.LEAST_ID)) > F.col("first_id")) & (F.col("n_bytes") >= window)
    return keyed.join(each, "digest").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
win AS (SELECT doc_id, i, md5(t[i : i + 99]) AS k FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM d)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
left_over AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, string_agg(hex(t[before + 1 : a - 1]), '' ORDER BY a) AS h, max(b) AS b FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN b IS NULL THEN t ELSE unhex(h || hex(t[b + 1 :])) END) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""
