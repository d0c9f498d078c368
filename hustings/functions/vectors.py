"""Dense vectors held as arrays of numbers."""

from __future__ import annotations

import hashlib
import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(doubles(v), lambda x: x / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def mean_vector(v: Column | str) -> Column:
    """Aggregate: mean of the vectors of a group, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(v))))


def centroid(df: DataFrame, by: list[str], vector: str = "embedding", out: str = "centroid") -> DataFrame:
    return df.groupBy(*by).agg(mean_vector(vector).alias(out), F.count("*").alias("n"))


def random_signs(k: int, size: int, seed: int = 42) -> list[list[float]]:
    """Signs of a seeded random projection, one row of length ``size`` per dimension."""
    def sign(i: int, j: int) -> float:
        digest = hashlib.md5(f"{seed}:{i}:{j}".encode()).digest()
        return 1.0 if digest[0] % 2 else -1.0

    scale = 1.0 / math.sqrt(k)
    return [[sign(i, j) * scale for j in range(size)] for i in range(k)]


def random_project(v: Column | str, k: int, size: int, seed: int = 42) -> list[Column]:
    rows = random_signs(k, size, seed)
    return [dot(v, F.array(*[F.lit(x) for x in row])) for row in rows]
