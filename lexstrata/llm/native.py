"""Column expressions and small plans shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of one long column that may be broadcast (about 32 MB as a hash table).
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def digest_of(text: Column) -> Column:
    """128 bits of SHA-256 of the whole text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def word_array(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def feature_rows(df: DataFrame, carried: list[str], buckets: int) -> DataFrame:
    """carried, uni, bi: a row per word of column ``words`` with the buckets of the word and of the pair it begins.

    ``buckets`` is a power of 2. The last word begins no pair (bi null); a row without words stays, with nulls.
    """
    rows = df.select(*carried, "words", F.posexplode_outer("words").alias("_i", "_w"))
    uni = F.when(F.col("_w").isNotNull(), F.xxhash64("_w").bitwiseAND(F.lit(buckets - 1)))
    after = F.get("words", F.col("_i") + 1)
    bi = F.when(after.isNotNull(), F.xxhash64("_w", after).bitwiseAND(F.lit(buckets - 1)))
    return rows.select(*carried, uni.alias("uni"), bi.alias("bi"))


def keys_for_join(keys: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` marked for broadcast if its counted rows stay under ``bound``.

    Beyond the bound it is left as it is, and the join shuffles both sides.
    """
    small = keys.limit(bound + 1).count() <= bound
    return F.broadcast(keys) if small else keys
