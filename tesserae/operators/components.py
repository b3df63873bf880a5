"""Connected components by alternating star contractions.

Every step is a grouped minimum and a join; the edge set shrinks towards one star per component, in a
logarithmic number of rounds. Each round is written to the shared checkpoint folder, so neither the
plan nor its recomputation grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _neighbours_min(pairs: DataFrame) -> DataFrame:
    """(u, v) lines with m = min of u and all its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _neighbours_min(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    linked = _neighbours_min(down)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """`vertices(u)` and undirected `edges(u, v)` of any orderable type -> (u, component = smallest member)."""
    current = cut_lineage(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if tuple(mark) == seen or mark["n"] == 0:
            break
        seen = tuple(mark)
        current = cut_lineage(_small_star(_large_star(current)))
    return vertices.select("u").distinct().join(current.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(
        "u", F.coalesce("v", "u").alias("component")
    )
