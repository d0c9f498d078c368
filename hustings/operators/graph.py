"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is tied to the smallest vertex of its neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("_m"))
    return both.where(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("_m"))
    near = down.join(least, "src")
    return near.select("dst", "_m").where(F.col("dst") != F.col("_m")).toDF("src", "dst").union(least.toDF("src", "dst")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def star_edges(edges: DataFrame) -> DataFrame:
    """``src, dst``: each vertex that has an edge, except the smallest of its component, with that smallest.

    Large and small stars in turn settle after a number of rounds that grows with the logarithm
    of the number of vertices, on long chains too; the loop ends when a round changes nothing.
    """
    now = cut_lineage(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    seen = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        shape = _fingerprint(now)
        if shape == seen:
            return now
        seen = shape


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex: ``id, component``. Vertices without an edge keep themselves."""
    stars = star_edges(edges).select(F.col("src").alias("id"), F.col("dst").alias("_root"))
    return vertices.select("id").join(stars, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))
