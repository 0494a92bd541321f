"""Vectors as short codes: a codebook for each part of the vector, trained by Elkan's Lloyd iterations.

With every row a table keeps, for each part, its entry, an upper bound of its distance to it and
a lower bound of its distance to each entry. A round shifts the bounds by how far entries
moved. Entry j is passed over where its lower bound, or half its distance to the
row's entry, is strictly above the upper bound; the rest are compared by exact integer distances,
ties to the lower index. Bounds are whole numbers, rounded to the safe side, so no comparison
depends on floating point.

The rows stay in their partitions throughout; a round moves sums of each part's entries alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import keys_for_join
from .storage import materialize, remove, shared_dir

SCALE = 256
#: Rows that are compared at once in a task.
SLICE = 1024
STATE = "id long, label int, v array<int>, entry array<int>, upper array<long>, lower binary"


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, label, v): rows whose vector has finite components alone, each as floor(256 x).

    Shorter vectors are filled up with zeros to the longest, and that to a multiple of the parts (in ``compress``).
    Components whose squares would pass 64-bit sums (beyond 2**19 in vectors of 64) count as that bound.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & finite).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.transform(x, lambda c: c.cast("double") * SCALE).alias("v"))


def _bounded(rows: DataFrame, size: int) -> DataFrame:
    most = 2 ** ((62 - (size - 1).bit_length()) // 2 - 1)
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c, F.lit(float(-most))), F.lit(float(most)))).cast("int"))
    return rows.withColumn("v", F.concat(whole, F.array_repeat(F.lit(0), F.lit(size) - F.size("v"))))


def root(square: np.ndarray, up: bool = False) -> np.ndarray:
    """Whole square roots, rounded down or up, of whole numbers below 2**62."""
    r = np.sqrt(square.astype(np.float64)).astype(np.int64)
    r -= r * r > square
    r += (r + 1) * (r + 1) <= square
    return r + (r * r < square) if up else r


def _distances(v: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of each row's parts (n, parts, width) to all entries (parts, entries, width)."""
    out = np.zeros((len(v), *books.shape[:2]), dtype=np.int64)
    for k in range(books.shape[2]):
        out += (v[:, :, None, k] - books[None, :, :, k]) ** 2
    return out


def first_round(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds of each part from all distances."""
    square = _distances(v, books)
    entry = square.argmin(axis=2)
    return entry, root(np.take_along_axis(square, entry[:, :, None], 2)[:, :, 0], up=True), root(square)


def next_round(v: np.ndarray, books: np.ndarray, apart: np.ndarray, moved: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``first_round``, from the last round's bounds; and how many distances were computed.

    apart: distances between entries of a part, rounded down; moved: how far each entry moved, rounded up.
    """
    n, parts = entry.shape
    at = np.arange(parts)
    upper = upper + moved[at, entry]
    lower = np.maximum(lower - moved[None], 0)
    open_ = lambda u, l, e, p: (l <= u[:, None]) & (apart[p, e] <= 2 * u[:, None]) & (np.arange(books.shape[1]) != e[:, None])
    row, part = np.divmod(np.flatnonzero(open_(upper.ravel(), lower.reshape(n * parts, -1), entry.ravel(), np.tile(at, n)).any(axis=1)), parts)
    own = entry[row, part]
    mine = ((v[row, part] - books[part, own]) ** 2).sum(axis=1)
    upper[row, part] = root(mine, up=True)
    lower[row, part, own] = root(mine)
    case, other = np.nonzero(open_(upper[row, part], lower[row, part], own, part))
    theirs = ((v[row[case], part[case]] - books[part[case], other]) ** 2).sum(axis=1)
    lower[row[case], part[case], other] = root(theirs)
    square = np.full((len(row), books.shape[1]), np.iinfo(np.int64).max)
    square[case, other] = theirs
    square[np.arange(len(row)), own] = mine
    best = square.argmin(axis=1)
    entry = entry.copy()
    entry[row, part] = best
    upper[row, part] = root(square[np.arange(len(row)), best], up=True)
    return entry, upper, lower, len(mine) + len(theirs)


def _rounds(books: np.ndarray, before: np.ndarray | None, last: bool):
    """A pass over the rows: the next state or, at the end, (id, label, entry, error)."""
    parts, entries, width = books.shape
    apart = root(((books[:, :, None] - books[:, None, :]) ** 2).sum(axis=3))
    moved = None if before is None else root(((books - before) ** 2).sum(axis=2), up=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                n = b.num_rows
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width).astype(np.int64)
                if moved is None:
                    entry, upper, lower = first_round(v, books)
                else:
                    numbers = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts).astype(np.int64)
                    lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), dtype="<i4").reshape(n, parts, entries).astype(np.int64)
                    entry, upper, lower, _ = next_round(v, books, apart, moved, numbers("entry"), numbers("upper"), lower)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts), pa.int32()), pa.array(x.ravel(), kind))
                if last:
                    error = ((v - books[np.arange(parts), entry]) ** 2).sum(axis=(1, 2))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists(entry, pa.int32()), pa.array(error)], ["id", "label", "entry", "error"])
                else:
                    low = np.minimum(lower, 2**31 - 1).astype("<i4").reshape(n, -1)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id"), b.column("label"), b.column("v"), lists(entry, pa.int32()), lists(upper, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())],
                        ["id", "label", "v", "entry", "upper", "lower"],
                    )

    return run


def _moved_to_means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after a round: floors of the means of their parts; unused ones stay."""
    width = books.shape[2]
    rows = state.select("v", F.posexplode("entry").alias("part", "e"))
    sums = [F.sum(F.get("v", F.col("part") * width + k).cast("long")).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    for r in rows.groupBy("part", "e").agg(F.count("*").alias("n"), *sums).collect():  # at most one row for each entry
        out[r["part"], r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(id, label, entry, error) of the rows that ``quantised`` keeps, and the codebooks (parts, entries, width).

    ``vectors``: vec_id, embedding, label. Codebooks start as the parts of the ``entries`` rows of least vec_id (equal
    ones by vector, null ones last); with fewer rows there are fewer entries, without rows the result is empty. Each of
    ``rounds`` rounds assigns all parts and moves entries to their means; then parts are assigned again.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = quantised(vectors)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(1, -(-longest // parts)) * parts
    rows = _bounded(rows, size)
    head = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r.v for r in head], dtype=np.int64).reshape(len(head), parts, size // parts).transpose(1, 0, 2)
    if not head:
        return spark.createDataFrame([], "id long, label int, entry array<int>, error long"), books
    before, state = None, rows
    for k in range(rounds):
        made = materialize(state.mapInArrow(_rounds(books, before, False), STATE), f"bounds_{k}", folder)
        if k:
            remove(spark, f"{folder}/bounds_{k - 1}")
        before, state, books = books, made, _moved_to_means(made, books)
    coded = materialize(state.mapInArrow(_rounds(books, before, True), "id long, label int, entry array<int>, error long"), "coded", folder)
    if rounds:
        remove(spark, f"{folder}/bounds_{rounds - 1}")
    return coded, books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error (null past 64 bits), codebooks_sha256."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    rows = coded.join(keys_for_join(sums), F.col("label").eqNullSafe(F.col("_label")))
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (
  SELECT vec_id, part, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT vec_id, part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {books} USING (part))
  GROUP BY vec_id, part, x)"""


def _means(name: str, assigned: str, before: str) -> str:
    return f"""{name}_m AS (
  SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c
  FROM (SELECT part, e, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, w + 1)) AS k FROM width) GROUP BY ALL) GROUP BY part, e),
{name} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN {name}_m m USING (part, e))"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
p AS (SELECT vec_id, k AS part, v[k * w + 1:k * w + w] AS x FROM kept, width, range(16) t(k)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_assigned("a1", "c0")},
{_means("c1", "a1", "c0")},
{_assigned("a2", "c1")},
{_means("c2", "a2", "c1")},
{_assigned("a3", "c2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""
