"""Repeated windows of texts: the plan that substring and suffix-array dedup share.

1. Copies of a text collapse to one row (``texts``), stored once in buckets by ``p``, the
   partition that wrote it; all later steps meet a text by its ``p`` and don't move it again.
2. Anchors: of each window of W units some k-gram is least (winnowing), and equal windows
   agree on it. Anchors that occur once in all texts rule out every window around them.
3. Windows around repeated anchors are sent, as runs that share their least k-gram, to a
   shard of that k-gram; equal windows meet there, and a reducer decides which are repeated.
4. The runs found return to their texts by ``p``.

Busy anchors and runs are settled where they are read: of equal ones in a partition one is
sent on, so a passage that a third of all texts hold reaches its shard once per partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import digest_of
from .rolling import BYTE_CODES, Block, U, blocks, mix, prefix_sums, sliding, span_hash, window_hash, winnow
from .storage import shared_dir

LEAST_ID = -(2**63)
ROUTED = "kind int, shard int, blob binary"
_ROUTED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary())])


@dataclass(frozen=True)
class Plan:
    """unit: 'byte' or 'word'; window: W units; gram: k of the anchors, W - k + 1 of them to a window."""

    unit: str
    window: int
    gram: int

    @property
    def spread(self) -> int:
        return self.window - self.gram + 1

    def units(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """A code for each unit, and the index of each text's first."""
        if self.unit == "byte":
            return BYTE_CODES[0][block.data], block.starts
        words = block.words()
        return words.codes[0], words.first


def distinct_texts(docs: DataFrame, folder: str) -> DataFrame:
    """digest, first_id (least doc_id; a null id is least of all), copies, text, p, tid, in buckets by p."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    merged = rows.withColumn("digest", digest_of(F.col("text"))).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("text").alias("text")
    )
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        merged.withColumn("p", F.spark_partition_id()).withColumn("tid", F.monotonically_increasing_id())
        .write.bucketBy(n, "p").option("path", f"{folder}/texts").option("compression", "zstd").format("parquet").saveAsTable(name)
    )
    table = spark.table(name)
    # The plan holds the files and their buckets; the catalog needn't keep a name for them.
    spark.sql(f"DROP TABLE {name}")
    return table


def shards_of(df: DataFrame) -> int:
    """One for each shuffle partition: a task sends each shard one blob, as a shuffle's map task does."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROUTED)], schema=_ROUTED)


def pack(*columns: np.ndarray) -> bytes:
    """Columns with their lengths and kinds."""
    head = [f"{c.dtype.str}:{len(c)}" for c in columns]
    return ",".join(head).encode() + b"\n" + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes) -> list[np.ndarray]:
    at = blob.index(b"\n")
    out, place = [], at + 1
    for part in blob[:at].decode().split(","):
        kind, _, n = part.partition(":")
        out.append(np.frombuffer(blob, dtype=kind, count=int(n), offset=place))
        place += int(n) * np.dtype(kind).itemsize
    return out


def groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the indices that have it."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(keys[part[0]]), part


def to_texts(tid: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Findings routed to the partitions of their texts."""
    for p, part in groups(tid >> 33):
        yield 1, p, pack(tid[part], *(c[part] for c in columns))


def anchors_of(plan: Plan, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, text (row in the block) and position in the text of each anchor; none in texts under W units."""
    codes, first = plan.units(block)
    hashes = window_hash(codes, plan.gram)
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = winnow(hashes, plan.spread)
    row = np.searchsorted(first, at, side="right") - 1
    good = (at + plan.gram <= first[row + 1]) & (np.diff(first)[row] >= plan.window)
    at, row = at[good], row[good]
    return hashes[at], row, at - first[row]


#: Anchors or windows that a task holds before it sends them.
HELD = 1 << 22


def _anchor_blobs(held: list[tuple[np.ndarray, ...]], shards: int) -> list[tuple[int, int, bytes]]:
    """Anchors (hash, tid, position) of a run of blocks: what repeats among them is settled, of equal ones one is sent."""
    h, tid, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
    _, place, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    local = count[inverse] > 1
    out = list(to_texts(tid[local], pos[local]))
    place.sort()
    h, tid, pos = h[place], tid[place], pos[place]
    for s, part in groups((h % U(shards)).astype(np.int64)):
        runs = np.flatnonzero(np.diff(tid[part], prepend=tid[part][0] - 1))
        out.append((0, s, pack((h[part] >> U(32)).astype(np.uint32), pos[part], tid[part][runs], np.diff(runs, append=len(part)).astype(np.int32))))
    return out


def _send_anchors(plan: Plan, shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            tids = batch.column("tid").to_numpy()
            for block in blocks(batch.column("text")):
                h, row, pos = anchors_of(plan, block)
                if len(h):
                    held.append((h, tids[block.rows][row], pos.astype(np.int32)))
                    size += len(h)
                if size >= HELD:
                    yield _batch(_anchor_blobs(held, shards))
                    held, size = [], 0
        if held:
            yield _batch(_anchor_blobs(held, shards))

    return run


def by_shard(batches: Iterator[pa.RecordBatch], settle: Callable[[list[bytes]], Iterator[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, shard): each shard's blobs go to ``settle`` together; findings pass."""
    held: list[bytes] = []
    now = None
    for batch in batches:
        passed = []
        for kind, shard, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 1:
                passed.append((1, shard, blob))
                continue
            if shard != now and held:
                if out := list(settle(held)):
                    yield _batch(out)
                held = []
            now = shard
            held.append(blob)
        if passed:
            yield _batch(passed)
    if held and (out := list(settle(held))):
        yield _batch(out)


def _settle_anchors(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    parts = [unpack(b) for b in blobs]
    h, pos = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    tid = np.concatenate([np.repeat(p[2], p[3]) for p in parts])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    yield from to_texts(tid[twice], pos[twice])


def dealt(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "kind", "shard").sortWithinPartitions("kind", "shard")


def repeated_anchors(texts: DataFrame, plan: Plan) -> DataFrame:
    """(kind, shard = p, blob of tid, pos): anchors that occur at two places or more."""
    sent = texts.select("tid", "text").mapInArrow(_send_anchors(plan, shards_of(texts)), ROUTED)
    return dealt(sent).mapInArrow(lambda it: by_shard(it, _settle_anchors), ROUTED)


def gathered(found: pa.Table) -> list[np.ndarray]:
    """The findings of one p, as columns sorted by tid."""
    parts = [unpack(b) for b in found.column("blob").to_pylist()]
    if not parts:
        return []
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


@dataclass
class Runs:
    """Candidate windows of a block as runs that share their least k-gram.

    row, start (in the text), n windows; at: first unit in the block; least: the k-gram.
    """

    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    at: np.ndarray
    least: np.ndarray
    codes: np.ndarray


def candidate_runs(plan: Plan, block: Block, tids: np.ndarray, found: list[np.ndarray], survivors: bool = False) -> Runs | None:
    """Windows that may repeat: around a repeated anchor or, where ``found`` holds all repeated k-grams, with one at each end."""
    codes, first = plan.units(block)
    if len(codes) < plan.window or not found:
        return None
    order = np.argsort(tids)
    lo, hi = np.searchsorted(found[0], tids[order[0]]), np.searchsorted(found[0], tids[order[-1]], side="right")
    tid, pos = found[0][lo:hi], found[1][lo:hi]
    where = np.minimum(np.searchsorted(tids[order], tid), len(order) - 1)
    ours = tids[order][where] == tid
    row = order[where[ours]]
    if not len(row):
        return None
    anchor = first[row] + pos[ours]
    if survivors:
        again = np.zeros(len(codes), dtype=bool)
        again[anchor] = True
        wanted = again[: len(codes) - plan.spread + 1] & again[plan.spread - 1 :]
    else:
        change = np.zeros(len(codes) + 1, dtype=np.int32)
        np.add.at(change, np.maximum(anchor - (plan.spread - 1), first[row]), 1)
        np.add.at(change, anchor + 1, -1)
        wanted = np.cumsum(change[:-1]) > 0
    starts = np.flatnonzero(wanted[: len(codes) - plan.window + 1])
    row = np.searchsorted(first, starts, side="right") - 1
    inside = starts + plan.window <= first[row + 1]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return None
    least = sliding(np.minimum, window_hash(codes, plan.gram), plan.spread)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(row) != 0) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    return Runs(row[begin], starts[begin] - first[row[begin]], np.diff(begin, append=len(starts)), starts[begin], least[begin], codes)


def run_names(plan: Plan, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run's units."""
    end = runs.at + runs.n + plan.window - 1
    return span_hash(prefix_sums(runs.codes), runs.at, end), span_hash(prefix_sums(mix(runs.codes + U(1)), 1), runs.at, end, 1)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + n)."""
    total = int(n.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(start - (ends - n), n)


def with_texts(texts: DataFrame, found: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``run`` on each p's texts and findings; the texts are read from their buckets, not shuffled."""
    right = found.select(F.col("shard").alias("p"), "blob")
    return texts.groupBy("p").cogroup(right.groupBy("p")).applyInArrow(run, ddl)


def covered(n: int, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Units covered by any of the windows at start .. start + count - 1."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def prepare(docs: DataFrame) -> tuple[DataFrame, str]:
    folder = shared_dir(docs.sparkSession)
    return distinct_texts(docs, folder), folder
