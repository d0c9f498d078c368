"""Near duplicates by SetSketch: registers of exponentially spaced minima, banded, estimated, verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.graph import star_edges
from ..session import stage_path
from .shared import WordHashes, free_name, mixed, pieces, query, table, window_hashes

# SetSketch with base 1.001 and 16-bit registers tells sets apart as finely as plain minima do.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
# 48 bands of 7 registers, each register in two bands. Sets of similarity 0.8 share no band
# once in about 100,000 pairs, of 0.85 once in 10 million.
REGISTERS, WIDTH, TURNS = 168, 7, 2
SKETCH_CHARS = 500_000
WORDS_KEPT = 500_000

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_BANDS = np.concatenate([_random.permutation(REGISTERS).reshape(-1, WIDTH) for _ in range(TURNS)])


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a text, A-Z taken as a-z.

    Fewer words than that count as one run; a text without words has an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    of = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    return np.unique(window_hashes(of, min(width, len(words))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row for each.

    Register i holds how far out the smallest of one exponential variable per element lies, on
    a scale of powers of the base. It depends on the set alone, and that of a union is the
    larger of the two registers.
    """
    elements = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((len(sets), REGISTERS))
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(elements * _FACTORS[i] + _SHIFTS[i], starts)
    share = (least + 1.0) / 2.0**64
    far = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(far) / math.log(BASE)), 0, LARGEST).astype(np.uint16)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    keys = np.empty((len(rows), len(_BANDS)), np.uint64)
    for k, places in enumerate(_BANDS):
        key = np.full(len(rows), k + 1, np.uint64)
        for p in places:
            key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, p].astype(np.uint64)
        keys[:, k] = mixed(key)
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity given registers and set sizes.

    Larger, smaller and equal registers are counted; the likelihood of the three counts is
    concave in the similarity and is climbed by halving.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    level = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + level * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        rising = fit(left) < fit(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, digest, n, registers, keys`` per row; an empty set has n = 0 and no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text", SKETCH_CHARS):
            if len(hashes) > WORDS_KEPT:
                hashes.clear()
            sets = [shingle_set(t, width, hashes) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, found, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                rows = registers([sets[i] for i in full])
                for i, row, own in zip(full, rows, band_keys(rows)):
                    digests[i], found[i], keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes(), own
            yield pa.record_batch(
                [
                    batch.column("id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(found, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "digest", "n", "registers", "keys"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, digest binary, n long, registers binary, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, elements`` of ``id, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            if len(hashes) > WORDS_KEPT:
                hashes.clear()
            sets = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                ["id", "n", "elements"],
            )

    return docs.mapInArrow(run, "id long, n long, elements array<long>")


@F.pandas_udf(T.DoubleType())
def _estimate(a, b, n_a, n_b):  # noqa: ANN001, ANN202
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    rows = [np.frombuffer(b"".join(x), np.uint16).reshape(len(x), REGISTERS) for x in (a, b)]
    return pd.Series(similarity(*rows, n_a.to_numpy(float), n_b.to_numpy(float)))


class _Linker:
    """Tests candidate pairs: sketches first, then full sets."""

    def __init__(self, sketch: DataFrame, sets: DataFrame, percent: int) -> None:
        self.sketch, self.sets, self.percent = sketch, sets, percent
        share = percent / 100
        # Six standard deviations below the bound: no true link is lost by the estimate.
        self.floor = share - 6 * math.sqrt(share * (1 - share) / REGISTERS)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` of which the full sets are similar enough, as ``src, dst``."""
        near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in ("a", "b"):
            own = self.sketch.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}"))
            near = near.join(own, side)
        sized = near.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        likely = sized.where(_estimate("r_a", "r_b", "n_a", "n_b") >= self.floor).select("a", "b")
        for side in ("a", "b"):
            own = self.sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("elements").alias(f"s_{side}"))
            likely = likely.join(own, side)
        common = F.size(F.array_intersect("s_a", "s_b"))
        checked = likely.withColumn("_c", common)
        return checked.where(100 * F.col("_c") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("_c"))).select(
            F.col("a").alias("src"), F.col("b").alias("dst")
        )


def _keep(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _open_buckets(buckets: DataFrame, stars: DataFrame, extra: list[Column]) -> DataFrame:
    """Rows of buckets whose members lie in more than one component, with their components."""
    labels = stars.select(F.col("src").alias("id"), F.col("dst").alias("_root"))
    placed = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("_root", "id").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), *extra)
    return placed.join(apart.where(F.col("_low") != F.col("_high")).drop("_low", "_high"), "key")


def _rare_element_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every pair of open buckets in different components that can still be a link.

    Exact bounds, not limits, keep the pairs few. Of a set, only elements that some other open
    set has can be shared, and they have to be ``percent`` of it. Two sets of sizes n and m with
    a link share ``t = s / (1 + s) * (n + m)`` elements, so with all elements in one order,
    rarest first, they share one of the first ``n - t + 1`` and ``m - t + 1``. What is rare in
    the copies of a text is what sets each of them apart.
    """
    open_sets = sets.join(rest.select("id").distinct(), "id", "left_semi")
    rows = open_sets.select("id", "n", F.explode("elements").alias("e"))
    counted = _keep(rows.groupBy("e").agg(F.count("*").alias("df"), F.min("id").alias("one")), "near-counts")
    alone = counted.where(F.col("df") == 1).groupBy(F.col("one").alias("id")).agg(F.count("*").alias("_alone"))
    sized = open_sets.select("id", "n").join(alone, "id", "left").select(
        "id", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("c")
    )
    able = _keep(rest.join(sized.where(100 * F.col("c") >= percent * F.col("n")), "id"), "near-able")
    smallest = able.groupBy("key").agg(F.min("n").alias("_low"))
    fits = F.greatest("_low", F.ceil(F.col("n") * percent / 100))
    reach = able.join(smallest, "key").groupBy("id", "n", "component").agg(F.min(fits).alias("_low")).withColumn(
        "_first", F.floor(F.col("n") - F.ceil((F.col("n") + F.col("_low")) * percent / (100 + percent)) + 1)
    )
    order = Window.partitionBy("id").orderBy("df", "e")
    shared = rows.select("id", "e").join(reach, "id").join(counted.where(F.col("df") > 1).select("e", "df"), "e")
    ranked = shared.withColumn("_rank", F.row_number().over(order))
    # Elements of one set alone come before all others and are only counted.
    known = sized.select("id", (F.col("n") - F.col("c")).alias("_before"))
    first = _keep(
        ranked.join(known, "id").withColumn("rank", F.col("_rank") + F.col("_before")).where(F.col("rank") <= F.col("_first"))
        .select("e", "id", "n", "component", "rank"), "near-first"
    )
    sides = first.groupBy("e", "component").agg(F.count("*").alias("_k"))
    several = sides.groupBy("e").agg(F.max_by("component", "_k").alias("_most"), F.count("*").alias("_sides")).where(F.col("_sides") > 1)
    some = first.join(several.select("e", "_most"), "e")
    names = ("id", "n", "component", "rank")
    left = some.where(F.col("component") != F.col("_most")).select("e", *[F.col(c).alias(f"{c}_a") for c in names])
    right = some.select("e", *[F.col(c).alias(f"{c}_b") for c in names])
    # A first shared element at these ranks leaves enough elements behind it in both sets.
    behind = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + 1
    possible = (F.col("component_a") != F.col("component_b")) & ((100 + percent) * behind >= percent * (F.col("n_a") + F.col("n_b")))
    return left.join(right, "e").where(possible).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def near_duplicate_components(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows of equal sets are one class, which its smallest id stands for. Classes that share a
    band are candidates. Three rounds find their links without listing the pairs of a bucket:

    1. each member of a bucket against the bucket's smallest id;
    2. in buckets that still hold several components, each member against one more member,
       picked by a hash of bucket and id, if that lies in another component;
    3. in what is left, members of different components that share one of their rarest elements,
       without which they cannot be linked.

    A pair counts when the full sets pass ``100 * common >= percent * union``.

    Empty sets (null text, no words) are linked with nothing. Rows that share an id count as one
    document. A null id never stands for others; alone in its class it is its own component.
    Other columns are ignored; an empty table gives an empty result.
    """
    sketch = _keep(sketches(docs, width, key, text), "near-sketch")
    full = sketch.where(F.col("digest").isNotNull())
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = full.join(classes.where(F.col("rep").isNotNull()).select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
    bands = reps.select("id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") != F.col("high"))
    buckets = _keep(bands.join(shared.select("key", "low"), "key"), "near-buckets")
    ids = buckets.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = _keep(full_sets(texts.join(ids, "id", "left_semi"), width), "near-sets")
    link = _Linker(sketch.where(F.col("digest").isNotNull()), sets, percent)

    edges = _keep(link(buckets.where(F.col("id") != F.col("low")).select(F.col("low").alias("a"), F.col("id").alias("b"))), "near-links")
    stars = star_edges(edges)
    turn = F.xxhash64("key", "id")
    pivot = F.min_by(F.struct("id", "component"), F.struct(turn.alias("t"), "id")).alias("_p")
    second = _open_buckets(buckets, stars, [pivot]).where(F.col("component") != F.col("_p.component"))
    more = _keep(link(second.select(F.col("_p.id").alias("a"), F.col("id").alias("b"))), "near-links")
    stars = star_edges(stars.union(more))

    rest = _keep(_open_buckets(buckets, stars, []), "near-open")
    last = _keep(link(_rare_element_pairs(rest, sets, percent)), "near-links")
    stars = star_edges(stars.union(last))

    roots = stars.select(F.col("src").alias("rep"), F.col("dst").alias("_root"))
    placed = classes.join(roots, "rep", "left").select("digest", F.coalesce("_root", "rep").alias("_c"))
    out = sketch.select("id", "digest", "n").join(placed, "digest", "left")
    component = F.coalesce("_c", "id")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document is the one that stays of its group, with all their columns."""
    found = near_duplicate_components(docs, width, percent)
    name = free_name(docs, "_gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


@query()
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by pairs of adjacent words."""
    return near_duplicate_components(table(spark, sf_dir, "documents"), width=2, percent=80)
