"""Embedding, projection, density clusters and their quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text, vectors
from ..session import cut_lineage
from .graph import connected_components
from .joins import per_distinct_text, salted_join
from .ordering import positions

Encoder = Callable[[list[str]], np.ndarray]


def embed_texts(df: DataFrame, col: str, encoder: Callable[[], Encoder] | None = None, size: int = 256) -> DataFrame:
    """Vector per row, worked out once per distinct text.

    ``encoder`` is called once per task and gives a function from texts to a matrix. Without
    one, hashed words weighted by rarity stand in. Vectors come out with unit length.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.tolist()), dtype="float64")))

    def work(distinct: DataFrame) -> DataFrame:
        if encoder is not None:
            raw = distinct.withColumn("_raw", encode(F.col(col)))
            return raw.withColumn("embedding", vectors.l2_normalize("_raw"))
        tokens = distinct.select("_digest", text.plain_words(col).alias("_words"))
        hashed = cut_lineage(HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size).transform(tokens).drop("_words"))
        weighted = IDF(inputCol="_tf", outputCol="_idf").fit(hashed).transform(hashed)
        unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
        return unit.withColumn("embedding", vector_to_array("_unit"))

    return per_distinct_text(df, col, work, "embedding")


def project(df: DataFrame, vector: str, k: int, size: int, method: str = "random", seed: int = 42) -> DataFrame:
    """Linear map to ``k`` coordinates ``x0 ..``: seeded random signs, or principal components."""
    if method == "random":
        coords = vectors.random_project(vector, k, size, seed)
        return df.withColumns({f"x{i}": c for i, c in enumerate(coords)})
    if method != "pca":
        raise ValueError(f"unknown projection: {method}")
    features = df.withColumn("_v", array_to_vector(vectors.doubles(vector)))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(features)
    parts = model.pc.toArray()
    signs = [1.0 if parts[np.argmax(np.abs(parts[:, i])), i] >= 0 else -1.0 for i in range(k)]
    out = model.transform(features).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({f"x{i}": F.col("_pc")[i] * signs[i] for i in range(k)}).drop("_v", "_pc")


def density_cluster(
    df: DataFrame, by: Sequence[str], coords: Sequence[str], width: float, min_points: int, min_size: int
) -> DataFrame:
    """Density clusters per parent, numbered from 0, with -1 for noise.

    Points fall into cells of the given width. Cells of at least ``min_points`` are dense,
    dense cells that share a face belong together, and groups of fewer than ``min_size``
    points are noise. Points meet only as cell counts, never as pairs, so a crowded cell
    costs one row.
    """
    by = list(by)
    cols = [f"_c{i}" for i in range(len(coords))]
    placed = df.withColumns({c: F.floor(F.col(x) / F.lit(width)) for c, x in zip(cols, coords)})
    cells = placed.groupBy(*by, *cols).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points)
    cells = cut_lineage(cells.select(F.struct(*by, *cols).alias("id"), "_n"))

    def moved(axis: str) -> Column:
        return F.struct(
            *[F.col(f"id.{b}").alias(b) for b in by],
            *[(F.col(f"id.{c}") + (1 if c == axis else 0)).alias(c) for c in cols],
        )

    steps = cells.select(F.col("id").alias("src"), F.explode(F.array(*[moved(c) for c in cols])).alias("dst"))
    edges = steps.join(cells.select(F.col("id").alias("dst")), "dst", "left_semi")
    linked = connected_components(cells, edges).join(cells, "id")
    sizes = linked.groupBy("component").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= min_size)
    flat = sizes.select(*[F.col(f"component.{b}").alias(b) for b in by], *[F.col(f"component.{c}").alias(c) for c in cols])
    numbered = positions(flat, cols, "label", by).select(
        F.struct(*by, *cols).alias("component"), F.col("label").cast("int").alias("label")
    )
    named = linked.join(numbered, "component").select(
        *[F.col(f"id.{b}").alias(b) for b in by], *[F.col(f"id.{c}").alias(c) for c in cols], "label"
    )
    out = placed.join(named, [*by, *cols], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(-1))).drop(*cols)


def silhouettes(df: DataFrame, by: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """Silhouette of every clustered point by squared distance, from cluster sums alone.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum
    and sum of squares, so points never meet points.
    """
    by = list(by)
    known = df.where(F.col("label") != -1)
    square = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in coords])
    stats = known.groupBy(*by, F.col("label").alias("_other")).agg(
        F.count("*").alias("_n"), F.sum(square).alias("_q"), *[F.sum(c).alias(f"_s_{c}") for c in coords]
    )
    cross = reduce(lambda a, b: a + b, [F.col(c) * F.col(f"_s_{c}") for c in coords])
    total = F.greatest(F.col("_n") * square - 2 * cross + F.col("_q"), F.lit(0.0))
    own = F.col("label") == F.col("_other")
    rest = [c for c in known.columns if c not in by]
    pairs = salted_join(known, stats, by, rest).select(
        *by, *rest,
        F.when(own, total / F.nullif(F.col("_n") - 1, F.lit(0))).alias("_in"),
        F.when(~own, total / F.col("_n")).alias("_out"),
    )
    near = pairs.groupBy(*by, *rest).agg(F.max("_in").alias("_a"), F.min("_out").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    value = F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))
    return near.withColumn("silhouette", F.when(a.isNull() | b.isNull(), 0.0).otherwise(value)).drop("_a", "_b")


def cluster_quality(df: DataFrame, by: Sequence[str], coords: Sequence[str], key: str) -> DataFrame:
    """Mean silhouette per parent, to be weighted with its number of points."""
    points = silhouettes(df.select(*by, key, "label", *coords), by, coords)
    scored = points.groupBy(*by).agg(F.avg("silhouette").alias("quality"), F.count("*").alias("clustered"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("points"))
    return sizes.join(scored, list(by), "left")


def weighted_quality(quality: DataFrame, without_noise: bool = False) -> DataFrame:
    weight = F.col("clustered" if without_noise else "points")
    return quality.where(F.col("quality").isNotNull()).agg(
        (F.sum(F.col("quality") * weight) / F.sum(weight)).alias("quality")
    )


BLOCK = 8_000_000  # numbers of cluster sums that are sent to the tasks at once


def _nearest(state: DataFrame, size: int) -> DataFrame:
    """Nearest other cluster of each, by mean squared distance of members: ``id, other, distance``.

    Blocks of clusters go to the tasks, which meet them with their rows as one matrix product.
    Equal distances go by the smaller, then the larger id of a pair, so some pair is mutual.
    """
    context = state.sparkSession.sparkContext
    per = max(1, BLOCK // size)
    edges: list = []
    kind = state.schema["id"].dataType.simpleString()
    if state.count() > per:
        starts = positions(state.select("id"), ["id"], "_at").where(F.col("_at") % per == 0)
        edges = sorted(r.id for r in starts.collect())
    found = []
    for k in range(max(len(edges), 1)):
        part = state
        if edges:
            part = part.where(F.col("id") >= F.lit(edges[k]))
            if k + 1 < len(edges):
                part = part.where(F.col("id") < F.lit(edges[k + 1]))
        rows = part.orderBy("id").collect()
        sent = context.broadcast(([r.id for r in rows], np.array([r.s for r in rows]), np.array([float(r.n) for r in rows]), np.array([r.q for r in rows])))

        def met(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, sums, counts, squares = sent.value
            means, inner = sums / counts[:, None], squares / counts
            for batch in batches:
                if not batch.num_rows:
                    continue
                mine = batch.column("id").to_pylist()
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                x = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1) / n[:, None]
                far = (batch.column("q").to_numpy(zero_copy_only=False) / n)[:, None] + inner[None, :] - 2 * x @ means.T
                far = np.round(np.maximum(far, 0.0), 12)
                out = []
                for i, own in enumerate(mine):
                    least, best = far[i], None
                    for j in np.flatnonzero(least <= np.partition(least, min(1, len(least) - 1))[min(1, len(least) - 1)]):
                        pair = (least[j], min(own, ids[j]), max(own, ids[j]), ids[j])
                        if ids[j] != own and (best is None or pair < best):
                            best = pair
                    if best is not None:
                        out.append((own, best[3], float(best[0])))
                if out:
                    columns = list(zip(*out))
                    yield pa.record_batch([pa.array(columns[0], batch.column("id").type), pa.array(columns[1], batch.column("id").type), pa.array(columns[2])], ["id", "other", "distance"])

        found.append(state.mapInArrow(met, f"id {kind}, other {kind}, distance double"))
    every = reduce(lambda a, b: a.union(b), found)
    order = F.struct("distance", F.least("id", "other").alias("_l"), F.greatest("id", "other").alias("_g"))
    return every.groupBy("id").agg(F.min_by("other", order).alias("other"), F.min("distance").alias("distance"))


def average_linkage(topics: DataFrame, key: str, vector: str) -> DataFrame:
    """Merges of an average-linkage hierarchy: ``left, right, distance, size``.

    A cluster is called by its smallest key. Every round merges all pairs of clusters that are
    each other's nearest; with average linkage a merge never brings clusters nearer to others, so
    the tree is the one that merging a pair at a time gives. The mean squared distance between
    clusters follows from their sizes, sums and sums of squares, so members never meet.
    """
    state = cut_lineage(topics.select(
        F.col(key).alias("id"), F.lit(1).cast("long").alias("n"), vectors.doubles(vector).alias("s"), vectors.dot(vector, vector).alias("q")
    ).where("id IS NOT NULL AND s IS NOT NULL"))
    size = state.agg(F.max(F.size("s"))).first()[0] or 1
    none = state.select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit(0.0).alias("distance"), F.col("n").alias("size")).limit(0)
    merges = [none]
    while state.limit(2).count() > 1:
        near = cut_lineage(_nearest(state, size))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = near.join(back, ["id", "other"]).where(F.col("id") < F.col("other")).select(F.col("id").alias("left"), F.col("other").alias("right"), "distance")
        lefts, rights = (state.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in "nsq"]) for side in ("left", "right"))
        joined = cut_lineage(pairs.join(lefts, "left").join(rights, "right"))
        if not joined.limit(1).count():
            raise RuntimeError("no two clusters are each other's nearest; vectors have to be finite")
        merges.append(joined.select("left", "right", "distance", (F.col("n_left") + F.col("n_right")).alias("size")))
        merged = joined.select(
            F.col("left").alias("id"), (F.col("n_left") + F.col("n_right")).alias("n"),
            F.zip_with("s_left", "s_right", lambda a, b: a + b).alias("s"), (F.col("q_left") + F.col("q_right")).alias("q"),
        )
        gone = joined.select(F.explode(F.array("left", "right")).alias("id"))
        state = cut_lineage(state.join(gone, "id", "left_anti").unionByName(merged))
    return reduce(lambda a, b: a.unionByName(b), merges)


def topic_hierarchy(topics: DataFrame, key: str, vector: str, parents: int) -> DataFrame:
    """Parent of each topic: the hierarchy of nearest topics cut into ``parents`` groups.

    Groups are numbered by their smallest topic and called after their central one. The
    ``parents - 1`` highest merges are undone; equal heights go by the names merged.
    """
    merges = cut_lineage(average_linkage(topics, key, vector))
    undone = merges.orderBy(F.desc("distance"), F.desc("left"), F.desc("right")).limit(max(parents - 1, 0))
    kept = merges.join(undone.select("left", "right"), ["left", "right"], "left_anti")
    named = topics.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    groups = connected_components(named.select(F.col(key).alias("id")), kept.select(F.col("right").alias("src"), F.col("left").alias("dst")))
    numbers = positions(groups.select("component").distinct(), ["component"], "parent").select("component", F.col("parent").cast("int").alias("parent"))
    placed = cut_lineage(named.join(groups.join(numbers, "component").select(F.col("id").alias(key), "parent"), key))
    centers = vectors.centroid(placed, ["parent"], vector, "_center").drop("n")
    near = placed.join(centers, "parent").withColumn("_cos", vectors.cosine(vector, "_center"))
    names = near.groupBy("parent").agg(
        F.min_by(key, F.struct((-F.col("_cos")).alias("_far"), F.col(key))).alias("parent_topic")
    )
    return placed.join(names, "parent").select(key, "parent", "parent_topic")
