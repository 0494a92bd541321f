"""Addresses seen across increments: a Bloom filter sifts, an exact table of keys decides.

A store is a folder with a part for each increment of two tables: ``keys``, the rows that were new, and
``words``, the filter's 64-bit words with the bits that those rows set, built by aggregate. A later increment ORs
all parts of ``words`` (of bounded size, whatever was seen), tells most of its new keys by them, and looks up the
others alone: while those are few enough to be broadcast, the keys seen before are scanned, never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.storage import exists, materialize, shared_dir

#: Bits of the filter (its words come to the driver and to every task: 32 MB at most), hashes of a key, keys that may be broadcast.
BITS, HASHES, BROADCAST_ROWS = 1 << 24, 4, 500_000
MOST_BITS = 1 << 28


def positions(key: Column, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(j)), F.lit(bits)) for j in range(HASHES)))


def filter_words(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, bits) of the filter that holds ``keys`` (key), null ones left out."""
    at = keys.where("key IS NOT NULL").select(F.explode(positions(F.col("key"), bits)).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))


def _read(spark: SparkSession, store: str, kind: str, before: int) -> DataFrame | None:
    if not exists(spark, f"{store}/{kind}"):
        return None
    return spark.read.option("basePath", f"{store}/{kind}").parquet(f"{store}/{kind}").where(F.col("batch") < before)


def maybe_seen(words: DataFrame, bits: int):
    """A function of positions: false if the filter of merged ``words`` lacks a bit, so that the key was never added."""
    table = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.uint64)
    filled[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = words.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf(T.BooleanType())
    def maybe(at: pa.Array) -> pa.Array:
        p = np.asarray(at.flatten().to_numpy(zero_copy_only=False)).reshape(-1, HASHES)
        hit = (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(hit.all(axis=1))

    return maybe


def add(links: DataFrame, number: int, store: str, order: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """The rows of increment ``number`` whose key no earlier increment had, the first of each key by ``order``; they are stored.

    ``links`` has key and any other columns; null keys are left out. An increment that runs again replaces what it stored.
    """
    if bits % 64 or not 64 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be a multiple of 64 up to {MOST_BITS}")
    spark, folder = links.sparkSession, shared_dir(links.sparkSession)
    rest = [c for c in links.columns if c != "key"]
    first = links.where("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("key", "r.*")
    keys, words = _read(spark, store, "keys", number), _read(spark, store, "words", number)
    if keys is not None:
        first = materialize(first.withColumn("_maybe", maybe_seen(words, bits)(positions(F.col("key"), bits))), "sifted", folder)
        asked = first.where("_maybe").select("key")
        asked = F.broadcast(asked) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else asked
        had = materialize(keys.select("key").join(asked, "key", "left_semi"), "had", folder)
        first = first.where("NOT _maybe").unionByName(first.where("_maybe").join(had, "key", "left_anti")).drop("_maybe")
    part = lambda kind: f"{store}/{kind}/batch={number}"
    first.write.mode("overwrite").option("compression", "zstd").parquet(part("keys"))
    new = spark.read.schema(first.schema).parquet(part("keys"))
    filter_words(new, bits).write.mode("overwrite").option("compression", "zstd").parquet(part("words"))
    return new
