"""Hierarchical density clusters per parent, and how valid they are.

Points fall into cells of a fine grid, and a crowded cell is one row however many points it
holds. A cell's core distance is how far it has to reach for enough points, two cells are as far
apart as the largest of their distance and both core distances. These mutual reachabilities are
square roots of whole numbers of cell widths, so the tree of clusters has few levels: the
components over the edges up to each length, all found in the same rounds, as a minimum spanning
forest gives them when equal edges go together. Neighbours are looked for up to ``reach`` cells
away; what is farther apart stays apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_path
from .graph import star_edges
from .ordering import positions

MOST_OFFSETS = 1_000


class DensityTree(NamedTuple):
    """Cells with their components on each level, mutual reachabilities, and clusters.

    ``cells``: parents, grid places, ``id``, ``n`` and ``c0, c1, ...``, null where a cell's core
    distance is beyond the level. ``edges``: ``a, b, level``. ``spans``: a row for each level of
    a cluster's life: ``cluster, level, comp, size``. ``chosen``: ``birth, comp, cluster``.
    """

    by: list[str]
    places: list[str]
    levels: list[int]
    width: float
    cells: DataFrame
    edges: DataFrame
    spans: DataFrame
    chosen: DataFrame

    def distance(self, level: int) -> float:
        return self.width * math.sqrt(max(self.levels[level], 0.25))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _levels(dims: int, reach: int) -> list[int]:
    squares = {0}
    for _ in range(dims):
        squares = {a + b * b for a in squares for b in range(reach + 1) if a + b * b <= reach * reach}
    return sorted(squares)


def _components(by: list[str], places: list[str], cells: DataFrame, levels: list[int], reach: int, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Cells with a column of components for each level, and the edges between cells."""
    steps = [o for o in product(range(-reach, reach + 1), repeat=len(places)) if 0 < sum(x * x for x in o) <= reach * reach]
    if len(steps) > MOST_OFFSETS:
        raise ValueError(f"{len(steps)} neighbours a cell are too many; use fewer dimensions or a shorter reach")
    moves = F.explode(F.array(*[F.struct(*[F.lit(x).alias(p) for p, x in zip(places, o)], F.lit(sum(x * x for x in o)).alias("d")) for o in steps]))
    moved = cells.select("id", *by, *places, moves.alias("_m")).select(
        F.col("id").alias("a"), *by, *[(F.col(p) + F.col(f"_m.{p}")).alias(p) for p in places], F.col("_m.d").alias("d")
    )
    near = _stored(moved.join(cells.select(F.col("id").alias("b"), *by, *places, F.col("n").alias("m")), [*by, *places]).select("a", "b", "d", "m"), "near")
    met = near.select(F.col("a").alias("id"), "d", "m").union(cells.select("id", F.lit(0), "n"))
    sums = met.groupBy("id").agg(*[F.sum(F.when(F.col("d") <= v, F.col("m"))).alias(f"_s{v}") for v in levels])
    core = sums.select("id", F.coalesce(*[F.when(F.col(f"_s{v}") >= min_points, F.lit(i)) for i, v in enumerate(levels)]).alias("core"))
    alive = _stored(cells.join(core, "id"), "cores")
    level_of = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("d")).cast("int") - 1
    one, two = (alive.where("core IS NOT NULL").select(F.col("id").alias(k), F.col("core").alias(f"core_{k}")) for k in "ab")
    pairs = near.where("a < b").join(one, "a").join(two, "b")
    edges = _stored(pairs.select("a", "b", F.greatest("core_a", "core_b", level_of).alias("level")), "edges")
    # All levels in the same rounds: a cell is a vertex on every level, an edge holds from its own up.
    count = len(levels)
    apiece = edges.select("a", "b", F.explode(F.sequence("level", F.lit(count - 1))).alias("i"))
    stars = star_edges(apiece.select((F.col("a") * count + F.col("i")).alias("src"), (F.col("b") * count + F.col("i")).alias("dst")))
    roots = stars.select(F.expr(f"src div {count}").alias("id"), (F.col("src") % count).alias("i"), F.expr(f"dst div {count}").alias("root"))
    wide = roots.groupBy("id").agg(*[F.max(F.when(F.col("i") == i, F.col("root"))).alias(f"c{i}") for i in range(count)])
    own = {f"c{i}": F.coalesce(f"c{i}", F.when(F.col("core") <= i, F.col("id"))) for i in range(count)}
    return _stored(alive.join(wide, "id", "left").withColumns(own), "tree"), edges


def density_tree(
    df: DataFrame, by: Sequence[str], coords: Sequence[str], width: float, min_points: int, min_size: int, reach: int = 3
) -> DensityTree:
    """Tree of density clusters, and the most stable clusters in it.

    From the widest level down, a cluster goes on in its one part of at least ``min_size``
    points, splits where there are several such parts, and ends where there is none. Its
    stability is the sum over its points of how much denser than at its start the place gets
    before the point drops out; clusters are kept where they are at least as stable as those
    below together. Density is one over distance; points of one cell count as half a cell apart.
    """
    by, coords = list(by), list(coords)
    places = [f"_p{i}" for i in range(len(coords))]
    levels = _levels(len(coords), reach)
    grid = df.groupBy(*by, *[F.floor(F.col(x) / F.lit(width)).alias(p) for x, p in zip(coords, places)]).agg(F.count("*").alias("n"))
    present = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in places])
    cells = _stored(grid.where(present).withColumn("id", F.monotonically_increasing_id()), "cells")
    cells, edges = _components(by, places, cells, levels, reach, min_points)
    top = len(levels) - 1

    def big(i: int) -> DataFrame:
        above = F.first(f"c{i + 1}").alias("above") if i < top else F.lit(None).cast("long").alias("above")
        return cells.where(F.col(f"c{i}").isNotNull()).groupBy(F.col(f"c{i}").alias("comp")).agg(F.sum("n").alias("size"), above).where(F.col("size") >= min_size)

    name = F.struct(F.col("birth"), F.col("comp").alias("comp"))
    now = _stored(big(top).withColumn("birth", F.lit(top)).withColumn("cluster", name).withColumn("parent", F.lit(None).cast("struct<birth:int,comp:long>")).withColumn("level", F.lit(top)), "span")
    spans = [now]
    for i in range(top - 1, -1, -1):
        parts = big(i)
        several = parts.groupBy("above").agg(F.count("*").alias("_k"))
        upper = now.select(F.col("comp").alias("above"), F.col("cluster").alias("_c"), F.col("birth").alias("_b"))
        joined = parts.join(several, "above").join(upper, "above").withColumn("birth", F.when(F.col("_k") > 1, i).otherwise(F.col("_b")))
        now = _stored(joined.select(
            "comp", "size", "above", "birth", F.when(F.col("_k") > 1, name).otherwise(F.col("_c")).alias("cluster"),
            F.when(F.col("_k") > 1, F.col("_c")).alias("parent"), F.lit(i).alias("level"),
        ), "span")
        spans.append(now)
    every = reduce(lambda a, b: a.unionByName(b), spans)

    density = [1 / (width * math.sqrt(max(v, 0.25))) for v in levels]
    gain = F.get(F.array(*[F.lit(density[i] - density[min(i + 1, top)]) for i in range(top + 1)]), F.col("level"))
    clusters = _stored(every.groupBy("cluster").agg(F.sum(F.col("size") * gain).alias("stability"), F.first("parent", ignorenulls=True).alias("parent")), "clusters")
    done: DataFrame | None = None
    for i in range(top + 1):
        born = clusters.where(F.col("cluster.birth") == i)
        if done is None:
            scored = born.withColumn("_below", F.lit(None).cast("double"))
        else:
            below = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("_below"))
            scored = born.join(below, "cluster", "left")
        kept = F.col("_below").isNull() | (F.col("stability") >= F.col("_below"))
        scored = scored.select("cluster", "parent", F.greatest("stability", "_below").alias("value"), kept.alias("kept"))
        done = _stored(scored if done is None else done.unionByName(scored), "values")
    chosen = done.where("kept").select(F.col("cluster.birth").alias("birth"), F.col("cluster.comp").alias("comp"), "cluster")
    return DensityTree(by, places, levels, width, cells, edges, every.select("cluster", "level", "comp", "size"), _stored(chosen, "chosen"))


def _labelled_cells(tree: DensityTree) -> DataFrame:
    """Parents, places, ``id``, ``n``, ``cluster`` and ``label`` of every cell, -1 for noise."""
    path = F.array(*[F.struct(F.lit(i).alias("birth"), F.col(f"c{i}").alias("comp")) for i in range(len(tree.levels))])
    found = tree.cells.select("id", F.inline(path)).where("comp IS NOT NULL").join(tree.chosen, ["birth", "comp"])
    widest = found.groupBy("id").agg(F.max_by("cluster", "birth").alias("cluster"))
    cells = tree.cells.select(*tree.by, *tree.places, "id", "n").join(widest, "id", "left")
    first = cells.where("cluster IS NOT NULL").groupBy(*tree.by, "cluster").agg(F.min(F.struct(*tree.places)).alias("_first"))
    flat = first.select(*tree.by, "cluster", *[F.col(f"_first.{p}").alias(p) for p in tree.places])
    numbered = positions(flat, tree.places, "label", tree.by).select("cluster", F.col("label").cast("int").alias("label"))
    return cells.join(numbered, "cluster", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def hierarchical_clusters(
    df: DataFrame, by: Sequence[str], coords: Sequence[str], width: float, min_points: int, min_size: int, reach: int = 3
) -> DataFrame:
    """Rows with the ``label`` of their density cluster within the parent, from 0, -1 for noise.

    Clusters are numbered by their first cell. Rows with a null coordinate are noise; a null
    parent is a parent of its own only for them.
    """
    tree = density_tree(df, by, coords, width, min_points, min_size, reach)
    cells = _stored(_labelled_cells(tree).select(*tree.by, *tree.places, "label"), "labels")
    placed = df.withColumns({p: F.floor(F.col(x) / F.lit(width)) for x, p in zip(coords, tree.places)})
    # One row a cell on the right, and rows of a crowded cell are dealt by all of its places.
    return placed.join(cells, [*tree.by, *tree.places], "left").withColumn("label", F.coalesce("label", F.lit(-1))).drop(*tree.places)


def density_validity(
    df: DataFrame, by: Sequence[str], coords: Sequence[str], width: float, min_points: int, min_size: int, reach: int = 3
) -> DataFrame:
    """Validity of the clusters per parent: ``points, clustered, clusters, validity, validity_clustered``.

    A cluster's sparseness is the longest edge its cells need to hang together, its separation
    the shortest mutual reachability to another cluster (``reach`` where none is that near);
    its validity is their difference over the larger one. Validities are weighted by points,
    over all points of the parent (noise counts as 0) or over the clustered ones.
    """
    tree = density_tree(df, by, coords, width, min_points, min_size, reach)
    cells = _stored(_labelled_cells(tree), "labels")
    far = F.array(*[F.lit(tree.distance(i)) for i in range(len(tree.levels))])
    whole = tree.spans.groupBy("cluster").agg(F.max("size").alias("_all"))
    sparse = tree.spans.join(whole, "cluster").where("size = _all").groupBy("cluster").agg(F.get(far, F.min("level")).alias("sparseness"))
    at = cells.where("cluster IS NOT NULL").select("id", "cluster")
    across = tree.edges.join(at.toDF("a", "_x"), "a").join(at.toDF("b", "_y"), "b").where("_x <> _y")
    ends = across.select(F.inline(F.array(F.struct(F.col("_x").alias("cluster"), "level"), F.struct(F.col("_y").alias("cluster"), "level"))))
    apart = ends.groupBy("cluster").agg(F.get(far, F.min("level")).alias("separation"))
    sizes = cells.where("cluster IS NOT NULL").groupBy(*tree.by, "cluster").agg(F.sum("n").alias("_n"))
    beyond = F.coalesce("separation", F.lit(tree.width * reach))
    each = sizes.join(sparse, "cluster").join(apart, "cluster", "left").withColumn(
        "_v", (beyond - F.col("sparseness")) / F.greatest(beyond, F.col("sparseness"))
    )
    scored = each.groupBy(*tree.by).agg(F.count("*").alias("clusters"), F.sum("_n").alias("clustered"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"))
    points = df.groupBy(*tree.by).agg(F.count("*").alias("points"))
    zero: Column = F.lit(0)
    return points.join(scored, tree.by, "left").select(
        *tree.by, "points", F.coalesce("clustered", zero).alias("clustered"), F.coalesce("clusters", zero).alias("clusters"),
        (F.coalesce("_sum", F.lit(0.0)) / F.col("points")).alias("validity"), (F.col("_sum") / F.col("clustered")).alias("validity_clustered"),
    )
