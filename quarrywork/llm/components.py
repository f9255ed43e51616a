"""Connected components of an edge table, by alternating large and small stars.

Every round replaces each vertex's edges by edges to the least neighbour, so
the number of rounds grows with the logarithm of the longest path, and no
vertex's neighbours gather in one row. Rounds are written tables in the shared
folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.llm.scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller vertex."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): each vertex that isn't the least of its component, and that least one. edges: (u, v) of comparable vertices, any direction, loops ignored."""
    now = scratch.write(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    state, k = None, 0
    while True:
        k += 1
        now = scratch.write(_small(_large(now)), f"{name}{k}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now
        if k > 2:
            scratch.drop(f"{name}{k - 2}")
        state = tuple(seen)
