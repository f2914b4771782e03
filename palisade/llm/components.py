"""Connected components by alternating large-star and small-star rounds (joins and aggregations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a long, b long)``; the component is its smallest node.

    Each round re-hangs neighbours on the smallest node seen, so the number of rounds grows with the logarithm of the
    graph. Minima are partially aggregated, no neighbourhood is collected, and each round's edges are written to the
    shared folder. Only a count and a checksum come to the driver. No edges: no rows.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.store(_tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    sign = _sign(now)
    for _ in range(MAX_ROUNDS):
        if not sign[0]:
            break
        old, now = now, scratch.store(_tidy(_small_star(_large_star(now))), "edges")
        scratch.drop(old)
        before, sign = sign, _sign(now)
        if before == sign:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u > v").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))
