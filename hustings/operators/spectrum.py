"""Leading directions of a speaker by topic matrix from its long cells, missing cells being 0.

Few topics: the topic by topic cross-products are summed inside the tasks and solved on the
driver. Many topics: a block of random directions is multiplied by the cells and their
transpose, round after round, until its best directions stand still; nothing as long as the
topics or the speakers leaves the tables. Means are never subtracted from the cells, what they
take away is a product of small sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_path
from .matrix import one_per_cell

GRAM = 1_000  # topics up to which cross-products go to the driver
SPARE = 10  # directions in a block besides those asked for
ROUNDS = 500


class Directions(NamedTuple):
    """Orthonormal directions, best first.

    ``gram`` holds the uncentred cross-products along them, ``coords`` the topic means along
    them; ``whole`` and ``mean_square`` are the sums of squares of cells and topic means. The
    directions are columns ``w0, w1, ...`` of ``table`` by topic, or an array by ``names``.
    """

    table: DataFrame
    names: list | None
    vectors: np.ndarray | None
    gram: np.ndarray
    coords: np.ndarray
    speakers: int
    topics: int
    whole: float
    mean_square: float

    @property
    def width(self) -> int:
        return len(self.gram)

    @property
    def scatter(self) -> np.ndarray:
        """Cross-products around the means."""
        return self.gram - self.speakers * np.outer(self.coords, self.coords)

    def mixed(self, by: np.ndarray, out: list[str]) -> DataFrame:
        """``topic`` and the directions mixed by the columns of ``by``."""
        if self.vectors is None:
            return self.table.select("topic", *_combined([f"w{i}" for i in range(self.width)], by, out))
        mixed = self.vectors @ by
        return self._typed(pa.table({"topic": pa.array(self.names), **{o: pa.array(mixed[:, i].copy()) for i, o in enumerate(out)}}))

    def long(self, by: np.ndarray) -> DataFrame:
        """``topic, dim, loading`` of the mixed directions, dimensions from 1."""
        dims = range(1, by.shape[1] + 1)
        if self.vectors is None:
            entries = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"l{i}").alias("loading")) for i in dims])
            return self.mixed(by, [f"l{i}" for i in dims]).select("topic", F.inline(entries))
        rows = pa.table({
            "topic": pa.array([t for t in self.names for _ in dims]), "dim": pa.array(np.tile(np.arange(1, by.shape[1] + 1, dtype=np.int32), len(self.names))),
            "loading": pa.array((self.vectors @ by).ravel()),
        })
        return self._typed(rows)

    def _typed(self, rows: pa.Table) -> DataFrame:
        kind = self.table.schema["topic"].dataType
        return self.table.sparkSession.createDataFrame(rows).withColumn("topic", F.col("topic").cast(kind))

    def strongest(self, by: np.ndarray) -> list[float]:
        """The largest value by size of each mixed column, sign kept, the first topic's of equals."""
        if self.vectors is not None:
            mixed = self.vectors @ by  # topics are in order, so the first largest one counts
            return [float(c[np.argmax(np.abs(c))]) for c in mixed.T] if len(mixed) else [0.0] * by.shape[1]
        out = [f"m{i}" for i in range(by.shape[1])]
        tops = [F.min_by(c, F.struct((-F.abs(F.col(c))).alias("_s"), F.col("topic"))).alias(c) for c in out]
        return [v or 0.0 for v in self.mixed(by, out).agg(*tops).first()] if out else []


def _combined(source: list[str], by: np.ndarray, out: list[str]) -> list[Column]:
    terms = [[F.col(s) * F.lit(float(x)) for s, x in zip(source, by[:, j])] for j in range(len(out))]
    return [reduce(lambda a, b: a + b, t).alias(o) for t, o in zip(terms, out)]


def _kept(cells: DataFrame) -> DataFrame:
    y = F.col("stance_score").cast("double")
    return one_per_cell(cells).select("speaker", "topic", y.alias("y")).where(F.col("y").isNotNull() & (F.col("y") != 0))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def directions(cells: DataFrame, k: int, centered: bool = True, gram: int = GRAM, tol: float = 1e-7) -> Directions:
    """At least the ``k`` leading directions of the matrix; all of them where cross-products are formed."""
    spark = cells.sparkSession
    everything = cells.select("topic").distinct()
    speakers, n_topics = cells.select("speaker").distinct().count(), everything.count()
    kept = _kept(cells)
    if n_topics <= gram:
        topics = sorted(r[0] for r in everything.collect())
        sums, products = _cross_products(kept, topics)
        means = sums / max(speakers, 1)
        centre = products - speakers * np.outer(means, means) if centered else products
        _, vectors = np.linalg.eigh(centre)
        vectors = vectors[:, ::-1]
        return Directions(
            everything, topics, vectors, vectors.T @ products @ vectors, vectors.T @ means, speakers, n_topics,
            float(np.trace(products)), float(means @ means),
        )
    return _range(_stored(kept, "cells"), everything, speakers, n_topics, k, centered, tol)


def speaker_rows(cells: DataFrame, topics: list, value: str) -> DataFrame:
    """``speaker, c``: places of a speaker's topics in the list, with the values; no more than there are topics."""
    places = cells.sparkSession.createDataFrame([(t, i) for i, t in enumerate(topics)], cells.select("topic").schema.add("place", "integer"))
    return cells.join(F.broadcast(places), "topic").groupBy("speaker").agg(F.collect_list(F.struct("place", value)).alias("c"))


def _cross_products(kept: DataFrame, topics: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of all topics."""
    m = len(topics)
    rows = speaker_rows(kept, topics, "y")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                cells = batch.column("c").slice(at, 1024)
                row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
                flat = cells.flatten()
                x = np.zeros((len(cells), m))
                x[row, flat.field("place").to_numpy(zero_copy_only=False)] = flat.field("y").to_numpy(zero_copy_only=False)
                total[:m] += x.T @ x
                total[m] += x.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(m + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["place", "part"])

    def summed(key: tuple, parts: pa.Table) -> pa.Table:
        flat = parts.column("part").combine_chunks().flatten().to_numpy().reshape(-1, m).sum(axis=0)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    schema = "place int, part array<double>"
    done = rows.select("c").mapInArrow(added, schema).groupBy("place").applyInArrow(summed, schema).collect() if m else []
    out = np.zeros((m + 1, m))
    for r in done:
        out[r.place] = r.part
    return out[m], out[:m]


def _range(kept: DataFrame, everything: DataFrame, n: int, m: int, k: int, centered: bool, tol: float) -> Directions:
    """Block iteration with the cells; the topic means are always within the block."""
    b = k + SPARE
    w, z = [f"w{i}" for i in range(b)], [f"z{i}" for i in range(b)]
    whole = kept.agg(F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0))).first()[0]
    sums = kept.groupBy("topic").agg(F.sum("y").alias("_s"))
    start = [F.col("mean").alias("w0"), *[(F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(i)), F.col("topic").cast("string"))), F.lit(8)), 16, 10).cast("double") / 2.0**31 - 1).alias(w[i]) for i in range(1, b)]]
    block = _stored(everything.join(sums, "topic", "left").select("topic", (F.coalesce("_s", F.lit(0.0)) / n).alias("mean")).select("topic", "mean", *start), "block")

    def products(df: DataFrame, columns: list[str]) -> np.ndarray:
        """Cross-products of columns: a task hands on its sums, which meet by their place."""
        size = len(columns)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size))
            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                total += x @ x.T
            yield pa.record_batch([pa.array(np.arange(size * size, dtype=np.int32)), pa.array(total.ravel())], ["place", "part"])

        parts = df.select(*columns).mapInArrow(added, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
        out = np.zeros(size * size)
        for r in parts.collect():
            out[r.place] = r.part
        return out.reshape(size, size)

    def orthonormal(inner: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(inner)
        floor = max(values.max(), 1e-300) * 1e-14
        return vectors / np.sqrt(np.maximum(values, floor)) * (values > floor)

    def mixing(df: DataFrame, by: np.ndarray, columns: list[str], out: list[str]) -> DataFrame:
        """``topic, mean`` and the columns mixed by a small matrix."""
        def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) @ by
                yield pa.record_batch([batch.column("topic"), batch.column("mean"), *x.T.copy()], ["topic", "mean", *out])

        kind = df.schema["topic"].dataType.simpleString()
        return df.mapInArrow(mixed, f"topic {kind}, mean double, " + ", ".join(f"{o} double" for o in out))

    last, by, source = None, orthonormal(products(block, w)), w
    for _ in range(ROUNDS):
        now = mixing(block, by, source, w)
        along = kept.join(now.select("topic", *w), "topic").groupBy("speaker").agg(*[F.sum(F.col("y") * F.col(c)).alias(c) for c in w])
        back = kept.join(along, "speaker").groupBy("topic").agg(*[F.sum(F.col("y") * F.col(a)).alias(c) for a, c in zip(w, z)])
        block = _stored(now.join(back, "topic", "left").select("topic", "mean", *w, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in z]), "block")
        every = products(block, [*w, *z, "mean"])
        base = orthonormal(every[:b, :b])  # what rounding left of it
        gram = base.T @ (every[:b, b : 2 * b] + every[b : 2 * b, :b]) @ base / 2
        c, mm = base.T @ every[:b, 2 * b], every[2 * b, 2 * b]
        zz, zm = base.T @ every[b : 2 * b, b : 2 * b] @ base, base.T @ every[b : 2 * b, 2 * b]
        values, turn = np.linalg.eigh(gram - n * np.outer(c, c) if centered else gram)
        values, turn = values[::-1], turn[:, ::-1]
        # |S w - value w|^2 of the leading ones, S w being z less what the means take away.
        cross = n * np.outer(zm, c)
        squares = zz - cross - cross.T + n * n * mm * np.outer(c, c) if centered else zz
        sizes = np.einsum("ij,ik,kj->j", turn, squares, turn)
        rest = np.sqrt(np.maximum(sizes[:k] - values[:k] ** 2, 0.0)).max(initial=0.0)
        if rest <= tol * max(values[0], 1e-300) or (last is not None and np.allclose(values[:k], last, rtol=1e-15, atol=0)):
            held = _stored(mixing(block, base @ turn, w, w).drop("mean"), "directions")
            return Directions(held, None, None, turn.T @ gram @ turn, turn.T @ c, n, m, whole, mm)
        last = values[:k]
        # The next block: S times the directions, the means in the place of the weakest.
        sized = (turn / np.sqrt(np.maximum(sizes, 1e-300)))[:, : b - 1]
        by, source = np.zeros((b + 1, b)), [*z, "mean"]
        by[:b, : b - 1], by[b, b - 1] = base @ sized, 1.0
        if centered:
            by[b, : b - 1] = -n * (c @ sized)
        by = by @ orthonormal(by.T @ every[b:, b:] @ by)
    raise RuntimeError(f"the leading directions did not settle in {ROUNDS} rounds")
