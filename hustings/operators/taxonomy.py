"""Assembling and measuring the policy area, subtopic_1, subtopic_2 tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, vectors
from ..session import cut_lineage
from .joins import salted_join
from .ordering import first_by, top_per_group

MAX_IDS_PER_CELL = 10_000


def join_ids(
    links: DataFrame, node: Sequence[str], id_col: str, cell: int = MAX_IDS_PER_CELL
) -> DataFrame:
    """Link rows to ``;``-joined id lists for a text sink.

    A node of more ids than a cell should hold is spread by hash over several rows, told
    apart by ``part``, so a huge node is never gathered in one place.
    """
    sizes = links.groupBy(*node).agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(cell))
    spread = links.join(sizes, list(node)).withColumn(
        "part", F.pmod(F.xxhash64(id_col), F.greatest(parts, F.lit(1)))
    )
    return spread.groupBy(*node, "part").agg(
        F.array_join(F.array_sort(F.collect_set(id_col)).cast("array<string>"), ";").alias("ids")
    )


def explode_ids(df: DataFrame, col: str = "source_indices", out: str = "doc_id") -> DataFrame:
    """``;``-joined ids to one row per id."""
    ids = F.filter(F.transform(F.split(col, ";"), lambda s: F.trim(s).try_cast("bigint")), lambda i: i.isNotNull())
    return df.withColumn(out, F.explode(ids)).drop(col)


def node_documents(docs: DataFrame, path: Sequence[str]) -> DataFrame:
    """Link table of topic paths and documents."""
    return docs.select(*path, "doc_id").distinct()


def enforce_majority(
    df: DataFrame, key: str, label: str, order: str, by: Sequence[str] = (), misc: str | None = None
) -> DataFrame:
    """Give equal items the label most of them have; first seen wins ties, noise votes too.

    Items equal to ``misc`` become noise. Votes are counted per (item, label) before they
    meet, so any number of copies of one item comes down to a row per label.
    """
    votes = df.groupBy(*by, key, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = votes.groupBy(*by, key).agg(
        F.min_by(label, F.struct((-F.col("_n")).alias("_v"), F.col("_first"))).alias("_best")
    )
    won = df.join(best, [*by, key]).withColumn(label, F.col("_best")).drop("_best")
    if misc is None:
        return won
    return won.withColumn(label, F.when(F.col(key) == misc, -1).otherwise(F.col(label)))


def medoids(
    df: DataFrame, by: Sequence[str], vector: str, item: str, order: str, out: str = "medoid"
) -> DataFrame:
    """Member of each group closest to the group's mean by cosine, the first one on ties."""
    centers = vectors.centroid(df, list(by), vector, "_center").drop("n")
    near = salted_join(df, centers, list(by), [order]).withColumn("_cos", vectors.cosine(vector, "_center"))
    return near.groupBy(*by).agg(
        F.min_by(item, F.struct((-F.col("_cos")).alias("_far"), F.col(order))).alias(out)
    )


def mean_text(df: DataFrame, by: Sequence[str], vector: str, item: str, order: str) -> DataFrame:
    """Text nearest to the mean of the distinct texts of a group; noise is called ``Misc.``."""
    once = first_by(df.select(*by, item, vector, order), [*by, item], [order])
    found = medoids(once, by, vector, item, order, "mean_text")
    return found.withColumn(
        "mean_text", F.when(F.col(by[-1]) == -1, fixed.MISC).otherwise(F.col("mean_text"))
    )


def promote_single(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Where a parent has one label only, even noise, all of it becomes cluster 1."""
    kinds = df.groupBy(*by).agg(F.count_distinct(label).alias("_kinds"))
    return df.join(kinds, list(by)).withColumn(
        label, F.when(F.col("_kinds") == 1, 1).otherwise(F.col(label))
    ).drop("_kinds")


def route_small(df: DataFrame, by: Sequence[str], k: int, parent: str | None = None) -> DataFrame:
    """Marks rows of parents too small to cluster (fewer than k + 2 rows) or called ``Misc.``."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    small = F.col("_n") < k + 2
    if parent is not None:
        small = small | (F.col(parent) == fixed.MISC)
    return df.join(sizes, list(by)).withColumn("bypass", small).drop("_n")


def bypass_label(parent: str | None = None) -> Column:
    """Topic of a bypassed row: none below ``Misc.``, else ``Misc.``."""
    if parent is None:
        return F.lit(fixed.MISC)
    return F.when(F.col(parent) != fixed.MISC, fixed.MISC)


def cluster_summary(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("clusters"),
        F.count_if(F.col(label) == -1).alias("noise"),
    )


def term_weights(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class-level term weights: count in the class times ln(1 + mean class size / count in all).

    ``tokens`` has the class columns and ``term``, one row per word.
    """
    # Read three times below: written once, so that texts are not cut into words again.
    tf = cut_lineage(tokens.groupBy(*by, "term").agg(F.count("*").alias("tf")))
    total = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    sizes = tf.groupBy(*by).agg(F.sum("tf").alias("_s"))
    mean = sizes.agg(F.avg("_s")).scalar()
    weight = F.col("tf") * F.ln(F.lit(1.0) + mean / F.col("f"))
    return tf.join(total, "term").withColumn("weight", F.round(weight, 9))


def topic_labels(tokens: DataFrame, by: Sequence[str], k: int = 10, sep: str = "_") -> DataFrame:
    """Name of each class: its ``k`` heaviest terms, joined."""
    top = top_per_group(term_weights(tokens, by), by, [F.desc("weight"), F.asc("term")], k)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return top.groupBy(*by).agg(F.array_join(named, sep).alias("topic_label"))


def build_taxonomy(
    members: DataFrame, labels: DataFrame, centers: DataFrame, parent: Sequence[str]
) -> DataFrame:
    """One row per node: size, documents, medoid and name; noise is a ``Misc.`` node.

    ``members`` has the parent columns, ``label``, ``doc_id``; ``labels`` and ``centers`` give
    ``topic_label`` and ``medoid`` per node. Members and documents stay in the link table.
    """
    by = [*parent, "label"]
    nodes = members.groupBy(*by).agg(
        F.count("*").alias("cluster_length"), F.count_distinct("doc_id").alias("documents")
    )
    out = nodes.join(centers, by, "left").join(labels, by, "left")
    noise = F.col("label") == -1
    return out.withColumns(
        {
            "medoid": F.when(noise, "Misc. (Noise)").otherwise(F.col("medoid")),
            "topic_label": F.when(noise, fixed.MISC).otherwise(F.col("topic_label")),
        }
    )


def taxonomy_tree(nodes: DataFrame, size: str = "cluster_length") -> DataFrame:
    """Tree of counts: root, policy areas, subtopics; shares of parent and whole, places among siblings.

    Below a ``Misc.`` subtopic_1 there is no further level.
    """
    levels = ["policy_area", "subtopic_1", "subtopic_2"]
    counts = (
        nodes.rollup(*levels)
        .agg(F.sum(size).alias("n"), F.grouping_id().alias("_g"))
        .withColumn(
            "level",
            F.when(F.col("_g") == 7, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 1, 2).otherwise(3),
        )
        .drop("_g")
        .where((F.col("level") < 3) | (F.col("subtopic_1") != fixed.MISC))
    )
    up = counts.where("level < 3").select(
        (F.col("level") + 1).alias("level"),
        F.col("policy_area").alias("_p"),
        F.col("subtopic_1").alias("_s"),
        F.col("n").alias("_up"),
    )
    parent_area = F.when(F.col("level") > 1, F.col("policy_area"))
    parent_topic = F.when(F.col("level") > 2, F.col("subtopic_1"))
    keyed = counts.withColumns({"_p": parent_area, "_s": parent_topic})
    same = (
        (keyed["level"] == up["level"]) & keyed["_p"].eqNullSafe(up["_p"]) & keyed["_s"].eqNullSafe(up["_s"])
    )
    whole = nodes.agg(F.sum(size)).scalar()
    out = keyed.join(up, same, "left").select(
        keyed["level"], *levels, "n", keyed["_p"], keyed["_s"],
        (F.col("n") * 100 / F.coalesce("_up", "n")).alias("pct_of_parent"),
        (F.col("n") * 100 / whole).alias("pct_of_total"),
    )
    place = Window.partitionBy("level", "_p", "_s").orderBy(F.desc("n"), *levels)
    return out.withColumn("place", F.row_number().over(place)).drop("_p", "_s")


def level_counts(paths: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Topics and documents per level of the paths."""
    parts = [
        paths.agg(
            F.lit(i).alias("level"),
            F.count_distinct(*[F.col(c) for c in levels[: i + 1]]).alias("topics"),
            F.count_distinct(F.when(F.col(levels[i]).isNotNull(), F.col("doc_id"))).alias("documents"),
        )
        for i in range(len(levels))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
