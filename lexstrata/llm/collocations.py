"""Phrases whose words occur together more than by chance, by language.

First pass: every task adds its words and phrases to count-min sketches, which are merged cell by
cell. A cell is never less than the count of a phrase in it, so a phrase below the threshold in
some row of cells is rare for certain. Second pass: the other phrases are counted exactly, by their
words, so nothing frequent is lost and nothing rare that shares its cells is kept. Parts of a frequent
phrase are as frequent, so the same counts score each way of cutting a phrase in two; phrases that
are mostly the inside of a longer one go.

Sketches saturate at the threshold: their cells are bytes, and whether a merged cell reaches it is
the same. Their width follows from the bytes of text, up to MOST_CELLS; beyond, more rare phrases
reach the second pass, and the result is the same.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import keys_for_join
from .rolling import U, mix
from .storage import materialize, shared_dir

#: A to Z folded, tabs as spaces, and each mark that ends a piece as the first of them.
MARKS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + MARKS, bytes(range(97, 123)) + b" " + b"." * len(MARKS))
#: Rows of the sketch; least and greatest number of cells of a row; cells of a block, as which tasks send them.
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
LEAST_CELLS, MOST_CELLS, BLOCK = 1 << 16, 1 << 28, 1 << 16
#: Words of the runs of whole texts that are counted at once; cells of such runs that a task sums before it sends them.
RUN, HELD = 1 << 19, 3 << 20
#: Bytes of text that a task of the second pass counts.
TASK_BYTES = 64 << 20
#: Words that take part in more than BUSY cuts are dealt over SALTS parts in joins, as one word may begin a third of all phrases.
BUSY, SALTS = 10_000, 16


class _Vocabulary(dict):
    """Word of one language to its number in the run's list of words."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        self.lang, self.words = lang, words
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return n


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[str, bytes]]]]:
    """(numbers of the words in order, 0 between pieces; language and bytes of each number) of runs of whole texts."""
    words, ids, by_lang = [("", b"")], array("i", [0]), {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            if lang not in by_lang:
                by_lang[lang] = _Vocabulary(lang, words)
            tokens = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(TABLE).replace(b".", b" . ").split()
            ids.extend(map(by_lang[lang].__getitem__, tokens))
            ids.append(0)
            if len(ids) >= RUN:
                yield np.array(ids, dtype=np.int64), words
                words, ids, by_lang = [("", b"")], array("i", [0]), {}
    yield np.array(ids, dtype=np.int64), words


def _grams(ids: np.ndarray, words: list[tuple[str, bytes]], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: where such phrases begin, and their 64-bit hashes."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in {lang for lang, _ in words}}
    codes = np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in words], dtype=np.uint64)[ids]
    whole, hashes = ids > 0, codes
    for k in range(1, longest + 1):
        if k > 1:
            whole = whole[:-1] & (ids[k - 1 :] > 0)
            hashes = mix(hashes[:-1] * ODD[0] + codes[k - 1 :])
        at = np.flatnonzero(whole)
        yield at, hashes[at]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes + ODD[row]) * ODD[row]) >> U(64 - bits)


def _sketch(longest: int, least: int, bits: int):
    """(row, block, gaps, width, n, counts): cells of the runs of a task, summed up to HELD cells, in blocks; gaps between cells in use, counts up to ``least``."""

    def sent(held: list[list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, parts in enumerate(held):
            cells, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(cells, kind="stable")
            cells, first = np.unique(cells[order], return_index=True)
            counts = np.minimum(np.add.reduceat(counts[order], first, dtype=np.int64), least).astype(np.uint8) if len(cells) else counts
            block = cells // BLOCK
            cut = np.flatnonzero(np.diff(block)) + 1
            for c, n in zip(np.split(cells, cut), np.split(counts, cut)):
                if len(c):
                    which = int(c[0]) // BLOCK
                    gaps = np.diff(c.astype(np.int64) - which * BLOCK, prepend=0).astype(np.uint16)
                    small = gaps.astype(np.uint8) if gaps.max() < 256 else gaps
                    out.append((row, which, pa.compress(small.tobytes(), "zstd", asbytes=True), small.itemsize, len(c), pa.compress(n.tobytes(), "zstd", asbytes=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["row", "block", "gaps", "width", "n", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in ODD], 0
        for ids, words in _runs(batches):
            hashes = np.concatenate([h for _, h in _grams(ids, words, longest)])
            for row in range(len(ODD)):
                cells, counts = np.unique(_cells(hashes, row, bits).astype(np.uint32), return_counts=True)
                held[row].append((cells, np.minimum(counts, least).astype(np.uint8)))
            size += len(held[0][-1][0])
            if size >= HELD:
                yield from sent(held)
                held, size = [[] for _ in ODD], 0
        if held[0]:
            yield from sent(held)

    return run


def _merge(least: int):
    """(row, block, often): the bits of the cells that reach ``least``; a task holds its blocks alone, never all that was sent to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, gaps, width, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums = held.setdefault((row, block), np.zeros(BLOCK, dtype=np.uint8))
                at = np.cumsum(np.frombuffer(pa.decompress(gaps, n * width, "zstd", asbytes=True), dtype=np.uint8 if width == 1 else np.uint16), dtype=np.int64)
                more = np.frombuffer(pa.decompress(counts, n, "zstd", asbytes=True), dtype=np.uint8)
                sums[at] = np.minimum(sums[at].astype(np.uint16) + more, least)
        for (row, block), sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["row", "block", "often"])

    return run


def _exact(longest: int, bits: int, often):
    """(lang, phrase, size, count): exact counts in each run of the phrases whose cells are full; of size 0 the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [np.frombuffer(b, dtype=np.uint8) for b in often.value]
        for ids, words in _runs(batches):
            langs, phrases, sizes, numbers = [], [], [], []
            for k, (at, hashes) in enumerate(_grams(ids, words, longest), 1):
                if k == 1:
                    place = {lang: i for i, lang in enumerate({lang for lang, _ in words})}
                    totals = np.bincount(np.array([place[lang] for lang, _ in words])[ids[at]], minlength=len(place))
                    for lang, i in place.items():
                        if totals[i]:
                            langs.append(lang), phrases.append(b""), sizes.append(0), numbers.append(int(totals[i]))
                for row, f in enumerate(full):
                    cells = _cells(hashes, row, bits)
                    hit = (f[cells >> U(3)] >> (U(7) - (cells & U(7))).astype(np.uint8)) & 1 > 0
                    at, hashes = at[hit], hashes[hit]
                key = ids[at]
                for j in range(1, k):
                    key = np.unique(key, return_inverse=True)[1] * len(words) + ids[at + j]
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                for i, n in zip(at[first].tolist(), counts.tolist()):
                    own = ids[i : i + k].tolist()
                    langs.append(words[own[0]][0]), phrases.append(b" ".join([words[w][1] for w in own])), sizes.append(k), numbers.append(n)
            columns = (pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), ["lang", "phrase", "size", "count"])

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, folder: str | None = None) -> DataFrame:
    """(lang, phrase, size, count): every phrase of 1 to ``longest`` words that occurs ``least`` times in its language.

    Rows of size 0 hold the number of words of each language. Null languages count as ``und``, null texts are empty.
    ``least`` is at most 255.
    """
    spark, folder = docs.sparkSession, folder or shared_dir(docs.sparkSession)
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    rows = docs.select(F.col("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(LEAST_CELLS, size // 16), MOST_CELLS - 1).bit_length()
    sent = rows.mapInArrow(_sketch(longest, least, bits), "row int, block int, gaps binary, width int, n int, counts binary")
    merged = sent.repartition("row", "block").mapInArrow(_merge(least), "row int, block int, often binary")
    full = [bytearray((1 << bits) // 8) for _ in ODD]
    for r in merged.toLocalIterator():  # at most MOST_CELLS bits for each row of the sketch
        full[r.row][r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = r.often
    often = spark.sparkContext.broadcast([bytes(f) for f in full])
    # A task of the second pass sends a phrase once, so tasks of more text send less; there are at least as many as cores.
    found = rows.coalesce(max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)).mapInArrow(_exact(longest, bits, often), "lang string, phrase string, size int, count long")
    counts = found.groupBy("lang", "phrase", "size").agg(F.sum("count").alias("count"))
    return materialize(counts.where((F.col("count") >= least) | (F.col("size") == 0)), "phrases", folder)


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def not_absorbed(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """Phrases of 2 words or more whose words lie in no longer phrase that has ``percent`` of their count."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _joined(words, i, n))))
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("_longer"))
    rows = phrases.where("size > 1").join(longer, ["lang", "phrase"], "left")
    return rows.where(~F.coalesce(100 * F.col("_longer") >= percent * F.col("count"), F.lit(False))).drop("_longer")


def with_scores(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate by its lowest-scoring cut, the first of equals.

    The score is floor(1,000,000 a a / (l r)), in exact decimals.
    """
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("count").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct(F.col("k").alias("size"), _joined(words, 1, F.col("k")).alias("part")).alias("first"), F.struct((F.col("size") - F.col("k")).alias("size"), _joined(words, F.col("k") + 1, F.col("size")).alias("part")).alias("rest"))
    used = cuts.select("lang", F.explode(F.array("first", "rest")).alias("p")).where("p.size = 1").groupBy("lang", F.col("p.part").alias("part")).agg(F.count("*").alias("_n"))
    busy = keys_for_join(used.where(F.col("_n") > BUSY).select("lang", "part", F.lit(True).alias("busy")))
    salts = lambda all_, one: F.when(F.coalesce("busy", F.lit(False)), all_).otherwise(one)
    every = F.explode(F.sequence(F.lit(0), salts(F.lit(SALTS - 1), F.lit(0))))
    parts = phrases.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("count").alias("f")).join(busy, ["lang", "part"], "left").select("lang", "part", "f", every.alias("salt"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.withColumn("part", F.col(f"{side}.part")).join(busy, ["lang", "part"], "left").withColumn("salt", salts(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"), F.lit(0))).drop("busy", side)
        cuts = cuts.join(parts, ["lang", "part", "salt"]).withColumnRenamed("f", name).drop("part", "salt")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("x", exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("y", exact("l") * exact("r")).withColumn("score", F.expr("x div y"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def leading(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows by score, count and phrase, with ``rank``.

    Ranked in parts, whose first rows are ranked again in 64 times fewer parts: no task sorts a language.
    """
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    while True:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        if parts == 1:
            return rows.drop("_part")
        parts = -(-parts // 64)
        rows = rows.withColumn("_part", F.pmod("_part", F.lit(parts)))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, absorbed: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's leading phrases of 2 to ``longest`` words.

    ``docs`` holds text and lang. a: count of the phrase; l, r: counts of the parts of its cut; n: words of the language.
    Repeated rows count again; empty tables, and languages without a phrase that occurs ``least`` times, give no rows.
    """
    folder = shared_dir(docs.sparkSession)
    phrases = frequent_phrases(docs, longest, least, folder)
    candidates = materialize(not_absorbed(phrases, absorbed), "candidates", folder)
    best = leading(with_scores(candidates, phrases), top)
    totals = phrases.where("size = 0").select("lang", F.col("count").alias("n"))
    return best.join(keys_for_join(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k.k AS size, unnest(list_transform(range(1, len(w) - k.k + 2), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) k(k) WHERE len(w) >= k.k),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
left_over AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * c.a),
cuts AS (
  SELECT lang, phrase, a, k.k AS k, array_to_string(w[1:k.k], ' ') AS first, array_to_string(w[k.k + 1:], ' ') AS rest
  FROM left_over, (VALUES (1), (2)) k(k) WHERE k.k < size),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
