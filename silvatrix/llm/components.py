"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped minima and two joins; the edge table of each round
is written to the shared folder. Neither edges nor labels reach the driver,
which only sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def contracted(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges with the components of ``edges(u, v)``, nearer to stars about their least vertices after each round."""
    now = materialize(_pairs(edges), "edges")
    for _ in range(rounds):
        old, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(old)
    return now


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(u, root)``; root is the least vertex that u reaches.

    Vertices that are their own root and vertices without an edge are left out.
    A round that changes nothing is the last; there are at most some log^2 of
    the vertices' number.
    """
    now = materialize(_pairs(edges), "edges")
    sign, was = (), None
    while sign != was:
        old, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(old)
        was, sign = sign, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    return now.select("u", F.col("v").alias("root"))
