"""Samples of edges without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(edges: DataFrame, k: int, order: Column | None = None, seed: int = 0) -> DataFrame:
    """k edges, or all if there are fewer: those that come first by a hash."""
    order = F.xxhash64("src", "dst", F.lit(seed)) if order is None else order
    return edges.orderBy(order, "src", "dst").limit(k)


def shuffled(df: DataFrame, key: Column) -> DataFrame:
    """Rows with their place (from 0) in a random order, that of a hash ``key`` of them."""
    from pairstrand.operators.simplify import _numbered

    return _numbered(df.withColumn("shuffle_key", key), "shuffle_key").drop("shuffle_key").withColumnRenamed("number", "place")


def weighted(edges: DataFrame, k: int, weight: str, seed: int = 0, u: Column | None = None) -> DataFrame:
    """k edges with positive weights, each chosen in proportion to its weight: the smallest of -ln(u) / weight, where u is a
    hash between 0 and 1."""
    if u is None:
        u = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return edges.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), "src", "dst").limit(k)
