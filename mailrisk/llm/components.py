"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").filter("v > _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``label`` for every node with a link to another; the label is the component's least node.

    Every round is written to the shared folder, so the plan stays short and lost executors cost no
    more than a task. Only a count and a checksum reach the driver. Rounds grow with the logarithm of the
    longest chain. Self-links, repeated links and nulls are ignored.
    """
    edges = (
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = materialise(edges, "links")
    seen = _digest(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = _digest(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = now
