"""Hashed embeddings and byte entropy (Arrow batches), cosine and centroids (expressions)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

DIM = 128


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(text: pa.Array) -> pa.Array:
    return kernels.embed(text, DIM)


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType() if k else T.IntegerType()) for k, c in enumerate(kernels.STYLE)]))
def style_measures(text: pa.Array) -> pa.Array:
    """All measures of a text's style and its byte entropy, in one pass."""
    return kernels.style(text)


def byte_entropy(text: str) -> Column:
    return style_measures(text)["char_entropy"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is absent or all zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def centroids(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Unit mean vector of each group; partial sums by (group, place)."""
    places = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    joined = places.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c"))
    norm = F.sqrt(dot(F.col("_c"), F.col("_c")))
    return joined.select(*by, F.transform("_c", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("centroid"))
