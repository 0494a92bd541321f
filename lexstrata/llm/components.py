"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Parts that the edges of one node are dealt over.
PARTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m, the least of a and its neighbours b.

    A hub's edges stay dealt over parts: the minimum of each part comes first, then that of
    the node (PARTS rows at most), which goes back to the parts that exist.
    """
    dealt = edges.withColumn("_p", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    parts = dealt.groupBy("a", "_p").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("_p").alias("_p"))
    return dealt.join(least.select("a", F.least("a", "m").alias("m"), F.explode("_p").alias("_p")), ["a", "_p"]).drop("_p")


def connected_components(edges: DataFrame, folder: str, name: str, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b), the least node it reaches.

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones
    (large-star, small-star), until every edge points to a root. Rounds grow with the
    logarithm of the nodes; each is written out, so a lost executor costs one round at most.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}_0", folder)
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_least(large)
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m"))
        then = materialize(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), f"{name}_{k}", folder)
        sums = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("a", "b") % 1000003).cast("long"))).first()
        if sums(then) == sums(now):
            break
        now = then
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
