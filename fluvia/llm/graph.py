"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours, with partial aggregation so that a hub costs little."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u1"), F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of u on the least vertex around u."""
    near = _both(edges)
    return (
        near.join(_least(near), F.col("u") == F.col("u1"))
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the least of them; edges arrive with u > v."""
    least = _least(edges)
    hung = edges.join(least, F.col("u") == F.col("u1")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("u1").alias("u"), F.col("m").alias("v"))
    return hung.union(own).filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100) -> DataFrame:
    """(vertex, root) for every vertex of an edge that isn't its component's least vertex.

    Edges are undirected; nulls, loops and repeated edges count for nothing, an empty table gives an
    empty result. Vertices may be of any ordered type. Each round's edges are a written table in the
    shared folder, and no component ever meets in one task: a hub's edges are aggregated before the
    shuffle and joined by keys that adaptive execution may split.
    """
    u, v = F.col(src), F.col(dst)
    edges = (
        edges.filter(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    now, seen = written(edges, "cc"), None
    for _ in range(max_rounds):
        count, total = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if (count, total) == seen or not count:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = (count, total)
        after = written(_small_star(_large_star(now)), "cc", rows=count)
        dropped(now)
        now = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
