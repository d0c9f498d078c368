"""Centroid clusters of whole-number vectors, with exact distances from bit planes.

A vector of 64 whole numbers is kept as its bit planes: bit k of all 64 components is one
64-bit word, the last plane carries the sign. A dot product is then a sum over pairs of planes
of the number of bits that both have set, times a power of two, and squared distances follow
from dot products, all in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage_path
from .shared import query, table

WIDTH = 64  # components of a vector, bits of a word
SCALE = 64
CENTROIDS, ROUNDS = 16, 3
ROWS = 4096  # vectors a task compares at once
NARROW = 28  # with up to so many planes, squared distances fit in 63 bits
LIMB = 40  # bits of a piece of a sum
LONGEST = 2**63 - 1


# Bit planes ------------------------------------------------------------------------------

def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of finite doubles, as Python numbers where 62 bits do not do."""
    scaled = np.floor(SCALE * x)
    if not len(scaled) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], object).reshape(scaled.shape)


def n_planes(values: np.ndarray) -> np.ndarray:
    """Planes that hold each row, its sign included, as a multiple of 4."""
    high, low = values.max(axis=1), values.min(axis=1)
    size = np.array([max(int(h).bit_length(), (-1 - int(l)).bit_length() if l < 0 else 0) + 1 for h, l in zip(high, low)], np.int64)
    return -(-size // 4) * 4


def to_planes(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` words for each row of 64 whole numbers."""
    out = np.empty((len(values), count), np.uint64)
    for k in range(count):
        shift = min(k, 63) if values.dtype == np.int64 else k
        bits = ((values >> shift) & 1).astype(np.uint8)
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``a`` with all rows of ``b``, both as planes."""
    wide = max(a.shape[1], b.shape[1]) > NARROW
    total = np.zeros((len(a), len(b)), object if wide else np.int64)
    for power in range(a.shape[1] + b.shape[1] - 1):
        part = np.zeros(total.shape, np.int32)
        for i in range(max(0, power - b.shape[1] + 1), min(power, a.shape[1] - 1) + 1):
            j = power - i
            both = np.bitwise_count(a[:, i, None] & b[None, :, j])
            if (i == a.shape[1] - 1) != (j == b.shape[1] - 1):  # one of them is a sign plane
                part -= both
            else:
                part += both
        total += part.astype(total.dtype) * (1 << power)
    return total


def _own_squares(values: np.ndarray) -> np.ndarray:
    wide = values.dtype == object or (len(values) and np.abs(values).max() >= 2 ** (NARROW - 1))
    return (values.astype(object) ** 2 if wide else values**2).sum(axis=1)


def nearest(planes: np.ndarray, square: np.ndarray, centroids: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance to it."""
    far = dots(planes, centroids) * -2 + squares[None, :] + square[:, None]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers again."""
    count = planes.shape[1]
    out = np.zeros((len(planes), WIDTH), np.int64 if count <= 62 else object)
    for k in range(count):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, k, None]).view(np.uint8), axis=1, bitorder="little").astype(out.dtype)
        out += bits * ((-1 if k == count - 1 else 1) * (1 << k))
    return out


# Tables ------------------------------------------------------------------------------------

PACKED = "vec_id {kind}, planes array<long>"


def _kept(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, _e`` of the rows with exactly 64 components, none null or not finite."""
    e = F.col("_e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("_e")).where(
        (F.size(e) == WIDTH) & finite
    )


def packed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, planes`` of the rows whose vector is kept."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = whole_numbers(part.column("_e").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
                count = n_planes(values)
                for n in np.unique(count):
                    here = np.flatnonzero(count == n)
                    flat = pa.array(to_planes(values[here], int(n)).view(np.int64).ravel())
                    rows = part.take(pa.array(here))
                    yield pa.record_batch(
                        [rows.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * np.int32(n)), flat)],
                        ["vec_id", "planes"],
                    )

    return _kept(vectors, vec_id, embedding).mapInArrow(run, PACKED.format(kind=kind))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a batch with their planes, those with equally many planes together."""
    sizes = batch.column("planes").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        rows = batch.filter(pa.array(sizes == n)) if (sizes != n).any() else batch
        for at in range(0, rows.num_rows, ROWS):
            part = rows.slice(at, ROWS)
            yield part, part.column("planes").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n)


def _limbs(sums: Sequence[int], limbs: int) -> list[list[int]]:
    """Pieces of ``LIMB`` bits of each sum, the last with its sign."""
    out = []
    for k in range(limbs):
        out.append([(s >> (LIMB * k)) & ((1 << LIMB) - 1) if k < limbs - 1 else s >> (LIMB * k) for s in sums])
    return out


def _of_limbs(rows: dict[int, list[int]]) -> list[int]:
    return [sum(v[i] << (LIMB * k) for k, v in rows.items()) for i in range(WIDTH)]


class Centroids:
    """Whole numbers of each centroid, and their planes."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        held = np.array(values, object).reshape(-1, WIDTH)
        if len(held) and max(abs(v) for row in values for v in row) < 2**62:
            held = held.astype(np.int64)
        self.planes = to_planes(held, int(n_planes(held).max())) if len(held) else np.empty((0, 4), np.uint64)
        self.squares = np.array([sum(v * v for v in row) for row in values], object)
        if self.planes.shape[1] <= NARROW:
            self.squares = self.squares.astype(np.int64)

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.values[k])).encode()).hexdigest()


def _seeds(vectors: DataFrame, count: int, vec_id: str, embedding: str) -> Centroids:
    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(SCALE))
        part = scaled % F.lit(1.0)
        return scaled - part - F.when(part < 0, 1.0).otherwise(0.0)

    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = _kept(vectors, vec_id, embedding).select(seed.alias("_seed"), F.transform("_e", whole).alias("_v"))
    first = rows.orderBy(F.col("_seed").asc_nulls_last(), "_v").limit(count).collect()
    return Centroids([[int(v) for v in r._v] for r in first])


def _moved(vectors: DataFrame, old: Centroids) -> Centroids:
    """Each centroid at the floored mean of its vectors; one without vectors stays.

    A task adds up its vectors and hands on one row for each centroid and piece of the sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(old.values), WIDTH), object)
        counts = np.zeros(len(old.values), np.int64)
        for batch in batches:
            for rows, planes in _blocks(batch):
                values = from_planes(planes)
                best, _ = nearest(planes, _own_squares(values), old.planes, old.squares)
                for k in np.unique(best):
                    mine = values[best == k]
                    sums[k] += mine.sum(axis=0).astype(object) if planes.shape[1] <= 48 else mine.astype(object).sum(axis=0)
                    counts[k] += len(mine)
        out: list[tuple] = []
        for k in np.flatnonzero(counts):
            whole = [int(s) for s in sums[k]]
            limbs = max(1, -(-max(abs(s) for s in whole).bit_length() // LIMB))
            out += [(int(k), i, int(counts[k]) if not i else 0, limb) for i, limb in enumerate(_limbs(whole, limbs))]
        if out:
            columns = list(zip(*out))
            yield pa.record_batch(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))],
                ["cluster", "limb", "n", "part"],
            )

    parts = vectors.select("planes").mapInArrow(run, "cluster int, limb int, n long, part array<long>")
    added = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(WIDTH)]).alias("part"))
    limbs: dict[int, dict[int, list[int]]] = {}
    counts: dict[int, int] = {}
    for r in added.collect():  # a few rows for each centroid
        limbs.setdefault(r.cluster, {})[r.limb] = r.part
        counts[r.cluster] = counts.get(r.cluster, 0) + r.n
    return Centroids([[s // counts[k] for s in _of_limbs(limbs[k])] if k in limbs else v for k, v in enumerate(old.values)])


def _assigned(vectors: DataFrame, centroids: Centroids, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, planes in _blocks(batch):
                best, far = nearest(planes, _own_squares(from_planes(planes)), centroids.planes, centroids.squares)
                if far.dtype == object:
                    far = np.array([min(int(f), LONGEST) for f in far], np.int64)
                yield pa.record_batch([rows.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(far.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "planes").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def centroid_clusters(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    Components become ``floor(64 * x)``. The first centroids are the vectors with the smallest
    hashes of ``1:<vec_id>``; equal hashes go by their components, rows without ``vec_id`` come last.
    Rounds move the centroids to the floored means of their vectors, exactly; then vectors are
    assigned for the last time. Null vectors, those of another length and those with null or
    not finite components have no row in the result; repeated rows count each for itself; with
    fewer vectors than centroids there are fewer clusters, an empty table gives an empty result;
    other columns are ignored. Assignment is exact for any finite components. Squared distances
    and their sums beyond 63 bits (components of more than a million) are given as 2^63 - 1.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    path = stage_path(spark, "planes")
    packed(vectors, vec_id, embedding).write.parquet(path)
    held = spark.read.parquet(path)
    at = _seeds(vectors, centroids, vec_id, embedding)
    for _ in range(rounds if at.values else 0):
        at = _moved(held, at)
    done = stage_path(spark, "assigned")
    if not at.values:
        held = held.where(F.lit(False))
    _assigned(held, at, kind).write.parquet(done)
    rows = spark.read.parquet(done)
    # One row for each centroid that has vectors.
    sums = {r.cluster: int(r.far) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}
    whole = min(sum(sums.values()), LONGEST)
    facts = [(k, min(far, LONGEST), whole, at.digest(k)) for k, far in sums.items()]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(centroids: int, rounds: int) -> str:
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        parts AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM kept, range(1, 65) AS r(i)),""",
        f"""c0 AS MATERIALIZED (SELECT k, i, v[i] AS x FROM (
          SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT {centroids}), range(1, 65) AS r(i)),""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""far{n} AS MATERIALIZED (SELECT rid, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS far FROM parts AS p JOIN c{n} AS c USING (i) GROUP BY rid, k),
        near{n} AS MATERIALIZED (SELECT rid, arg_min(k, (far, k)) AS k, min(far) AS far FROM far{n} GROUP BY rid),"""
        )
        if n < rounds:
            parts.append(
                f"""sum{n} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{n} JOIN parts USING (rid) GROUP BY k, i),
        c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} AS c LEFT JOIN sum{n} AS s ON s.k = c.k AND s.i = c.i),"""
            )
    return (
        "WITH " + "\n        ".join(parts) + f"""
        digests AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS d FROM c{rounds} GROUP BY k)
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
           CAST(sum(far) OVER () AS BIGINT) AS inertia, d AS centroid_sha256
    FROM near{rounds} JOIN kept USING (rid) JOIN digests USING (k)"""
    )


@query(_sql(CENTROIDS, ROUNDS))
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))
