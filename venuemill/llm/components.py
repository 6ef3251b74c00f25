"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuemill.llm.store import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, hung under the least neighbour of each node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b): component is the least node it reaches.

    Rounds of large and small stars until nothing moves (logarithmic in the size of a component in
    practice).  Each round is written to the shared folder; only a count and a sum come to the driver.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**40))).alias("s")).first()
        if mark == before:
            break
        before = mark
        now = stored(_stars(_stars(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
