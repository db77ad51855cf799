"""Vector retrieval with graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import expand


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(key).alias("uid"), cosine(F.col(column), q).alias("similarity")).orderBy(F.desc("similarity"), "uid").limit(k)


def hybrid(vectors: DataFrame, edges: DataFrame, query: list[float], k: int = 10, hops: int = 2, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest, then what lies within ``hops`` undirected steps, at score 0."""
    top = nearest(vectors, query, k, key, column)
    return top.union(expand(edges, top, hops).select("uid", F.lit(0.0).alias("similarity")))
