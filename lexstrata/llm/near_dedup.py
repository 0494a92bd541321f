"""Near-duplicate documents by circulant MinHash.

One permutation scatters the shingles; a second one, shifted circularly by k, gives signature
coordinate k. Rows of coordinates are banded; documents that share a band are candidates, and
links are confirmed on whole shingle sets. Texts with one shingle set are one class throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .native import keys_for_join
from .repeats import ranges
from .rolling import U, Block, Words, blocks, mix, window_hash
from .storage import materialize, shared_dir

#: A pair of similarity 0.85 shares no band with probability (1 - 0.85**6)**36 = 4e-8.
BANDS, ROWS = 36, 6
#: Members of one verification task of a whole bucket; larger buckets are verified in pairs of such parts.
PART = 1024
#: Members that one task compares with their bucket's least.
STAR = 128
#: Rows of five numbers that may be broadcast (about 25 MB as a hash table).
SMALL = 250_000
_u32 = np.uint32


def _permute(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    x ^= x >> _u32(16)
    x *= _u32(0x7FEB352D)
    x ^= x >> _u32(15)
    x *= _u32(0x846CA68B)
    x ^= x >> _u32(16)
    return x


def shingle_sets(block: Block, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another; bounds, one more than texts.

    A text of fewer than ``size`` words has its whole sequence as one shingle, or none.
    """
    first = words.first
    n = np.diff(first)
    hashes = window_hash(words.codes[0], size)
    count = np.maximum(n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    value = hashes[ranges(first[:-1], count)]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = [window_hash(words.codes[0][first[i] : first[i + 1]], int(n[i]))[0] for i in short]
        row, value = np.concatenate([row, short]), np.concatenate([value, np.array(own, dtype=np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, texts): coordinate k is the least of pi(sigma(shingle) + k), modulo 2**32; only for texts with shingles."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((coordinates, len(bounds) - 1), dtype=np.uint32)
    if not len(full):
        return out
    sigma = (mix(value) >> U(32)).astype(np.uint32)
    starts = bounds[full]
    for k in range(coordinates):
        out[k, full] = np.minimum.reduceat(_permute(sigma + _u32(k * 0x9E3779B1 & 0xFFFFFFFF)), starts)
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1), 1 << 20):
                value, bounds = shingle_sets(block, block.words(fold=True), size)
                sig = signatures(value, bounds, bands * rows)
                n = np.diff(bounds)
                key = np.zeros((bands, len(n)), dtype=np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        key[b] = mix(key[b] * U(0x9E3779B97F4A7C15) + sig[b * rows + r].astype(np.uint64) + U(b + 1))
                names = [hashlib.blake2b(value[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(len(n))]
                flat = pa.array(key.T.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(int(block.rows[0]), len(n)), pa.array(n.astype(np.int64)), pa.array(names, pa.binary()), lists], schema=_SKETCH)

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (left x right) with 100 |a & b| >= percent |a | b|, by index.

    Sizes and intersections are counted exactly: shared shingles as columns of a 0/1 matrix, in slices.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    uniq, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    total, step = int(shared.sum()), 4096
    cuts = np.searchsorted(column, np.arange(0, total + step, step))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        r, c = row[lo:hi], column[lo:hi] - k * step
        a = np.zeros((len(left), min(step, total - k * step)), dtype=np.float32)
        hit = place_l[r] >= 0
        a[place_l[r[hit]], c[hit]] = 1
        if left is right:
            b = a
        else:
            b = np.zeros((len(right), a.shape[1]), dtype=np.float32)
            hit = place_r[r] >= 0
            b[place_r[r[hit]], c[hit]] = 1
        inter += a @ b.T
    both = inter.astype(np.int64)
    union = n[left][:, None] + n[right][None, :] - both
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union)):
        x, y = find(int(left[i])), find(int(right[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(left[i]), int(right[j])))
    return out


def _verify(size: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, side = group.column("doc_id").to_numpy(), group.column("side").to_numpy()
        sets: list[np.ndarray] = []
        for block in blocks(group.column("text")):
            value, bounds = shingle_sets(block, block.words(fold=True), size)
            sets += [value[bounds[i] : bounds[i + 1]].copy() for i in range(len(bounds) - 1)]
        left = np.flatnonzero(side == 0)
        right = left if not (side == 1).any() else np.flatnonzero(side == 1)
        pairs = _links(sets, left, right, percent) if len(left) else []
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(ids[j]) for _, j in pairs], pa.int64())})

    return run


def _star_tasks(shared: DataFrame, folder: str) -> DataFrame:
    """(node, root, i, j, side): each bucket's least member against its others, a hub's others dealt over tasks of ``STAR`` or so."""
    others = shared.where("doc_id <> hub").select(F.col("hub").alias("root"), F.col("doc_id").alias("node")).distinct()
    fan = materialize(others.groupBy("root").agg(F.ceil(F.count("*") / STAR).alias("fan")), "fans", folder)
    each = others.join(keys_for_join(fan, SMALL), "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("fan")).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(1).alias("side"))
    hubs = fan.select(F.col("root").alias("node"), "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("side"))
    return each.unionByName(hubs)


def _part_tasks(member: DataFrame, percent: int, part: int) -> DataFrame:
    """(node, root, i, j, side): all pairs of parts of each bucket ``root`` (node, root, n_shingles), by set size; ruled out sizes left out."""
    counts = member.groupBy("root").agg(F.count("*").alias("_n"))
    # Members of a bucket in order of size, without sorting a bucket in one task: rank by exact size histogram.
    sizes = member.groupBy("root", "n_shingles").agg(F.count("*").alias("_k"))
    ahead = sizes.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("n_shingles", "_k"))).alias("h"))
    cut = F.expr(
        "transform(aggregate(h, cast(array() as array<struct<n: bigint, at: bigint, k: bigint>>), "
        "(acc, x) -> concat(acc, array(struct(x.n_shingles as n, if(size(acc) = 0, 0L, acc[size(acc) - 1].at + acc[size(acc) - 1].k) as at, x._k as k)))), x -> x)"
    )
    small = counts.where(F.col("_n") <= part).select("root")
    large = counts.where(F.col("_n") > part).select("root")
    base = member.join(small, "root", "left_semi").select("node", "root", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    placed = (
        member.join(ahead.join(large, "root", "left_semi").select("root", F.inline(cut)), "root")
        .where("n_shingles = n")
        .select("node", "root", "n_shingles", F.floor((F.col("at") + F.pmod(F.xxhash64("node"), F.col("k"))) / part).alias("i"))
    )
    spans = placed.groupBy("root", "i").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    other = spans.select("root", F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    blocks_ = spans.join(other, "root").where((F.col("i") <= F.col("j")) & (100 * F.col("hi") >= percent * F.col("lo2"))).select("root", "i", "j")
    one = placed.join(blocks_, ["root", "i"]).select("node", "root", "i", "j", F.lit(0).alias("side"))
    two = placed.select("node", "root", F.col("i").alias("j")).join(blocks_.where("i < j"), ["root", "j"]).select("node", "root", "i", "j", F.lit(1).alias("side"))
    return base.unionByName(one).unionByName(two)


def similar_links(docs: DataFrame, sketch: DataFrame, folder: str, *, size: int, percent: int, part: int) -> DataFrame:
    """Confirmed links (a, b) between class representatives; they connect all that similar pairs connect.

    Candidates are the pairs of one bucket (a band's value), never more. First each bucket's least member
    meets its others, which is linear. Then only buckets whose other members still lie in different
    components of confirmed links are verified whole, in pairs of parts of ``part`` members; of
    buckets with the same members one is.
    """
    reps = materialize(sketch.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("r.*"), "reps", folder)
    keys = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    busy = keys.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_max")).where("hub < _max").select("band", "hub")
    shared = materialize(keys.join(keys_for_join(materialize(busy, "busy", folder), SMALL), "band"), "shared", folder)
    texts = docs.select("doc_id", "text")

    def verified(tasks: DataFrame, name: str) -> DataFrame:
        dealt = materialize(tasks, f"{name}_tasks", folder).withColumnRenamed("node", "doc_id")
        found = texts.join(keys_for_join(dealt, SMALL), "doc_id").groupBy("root", "i", "j").applyInArrow(_verify(size, percent), "a long, b long")
        return materialize(found, f"{name}_links", folder)

    stars = connected_components(verified(_star_tasks(shared, folder), "star"), folder, "star_cc").select(F.col("node").alias("doc_id"), "root")
    others = shared.where("doc_id <> hub").join(stars, "doc_id", "left").select("band", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
    mark = F.xxhash64("doc_id")
    still = others.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n"), F.bit_xor(mark).alias("_x"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("_s")).where("_lo < _hi")
    one = keys_for_join(materialize(still.groupBy("_n", "_x", "_s").agg(F.min("band").alias("band")).select("band"), "unsettled", folder), SMALL)
    rest = verified(_part_tasks(others.join(one, "band", "left_semi").select(F.col("doc_id").alias("node"), F.col("band").alias("root"), "n_shingles"), percent, part), "rest")
    return rest.unionByName(stars.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, *, size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Sets of distinct ``size``-word shingles, A-Z in lower case, of whole texts; pairs with
    100 * intersection >= percent * union are linked, and component_id is the least doc_id
    reachable. Null, empty and blank texts have no shingles and no links; rows without an id
    take no part and come back with null component_id, kept; rows that repeat an id are one
    document for links if their texts agree, else each text counts; an empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInArrow(_sketch(size, bands, rows), SKETCH_DDL), "sketch", folder)
    known = sketch.where("doc_id IS NOT NULL")
    links = materialize(similar_links(docs.where("doc_id IS NOT NULL"), known, folder, size=size, percent=percent, part=part), "links", folder)
    roots = connected_components(links, folder, "links_cc")
    classes = known.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"))
    of_class = classes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("_root"))
    out = sketch.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("_root", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 44, rows: int = 5) -> DataFrame:
    """``docs`` without the rows whose document isn't the least of its group; rows without an id stay.

    A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**44 = 3e-8.
    """
    gone = near_duplicates(docs, size=size, percent=percent, bands=bands, rows=rows).where("NOT kept").select("doc_id").distinct()
    return docs.join(keys_for_join(materialize(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * shared >= 85 * (len(sa.g) + len(sb.g) - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
