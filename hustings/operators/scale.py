"""Positions out of speaker by topic scores: components and singular vectors; item response is imported."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .matrix import one_per_cell
from .response import ItemResponse, fit_irt, position_tables  # noqa: F401
from .spectrum import GRAM, Directions, directions, speaker_rows


WIDE = 16  # dimensions that are summed side by side
SPEAKERS = 256  # whose cells are laid out at a time


# Linear positions -----------------------------------------------------------------------

@dataclass
class Components:
    """Loadings per topic, the shift of each dimension, and what it explains in percent.

    ``found`` and ``by`` give the loadings; ``shift`` is the mean's place in each dimension.
    """

    found: Directions
    by: np.ndarray
    shift: list[float]
    explained: list[float]
    rows: int
    total_variance: float

    @property
    def loadings(self) -> DataFrame:
        """``topic, l1, l2, ...``."""
        return self.found.mixed(self.by, [f"l{i + 1}" for i in range(self.by.shape[1])])

    def loading_table(self) -> DataFrame:
        """``topic, dim, loading``."""
        return self.found.long(self.by)


def _components(found: Directions, by: np.ndarray, scatter: np.ndarray) -> Components:
    """Dimensions along the columns of ``by``, the strongest topic of each made positive."""
    by = by * np.where(np.array(found.strongest(by)) < 0, -1.0, 1.0)
    whole = found.whole - found.speakers * found.mean_square
    return Components(
        found,
        by,
        [float(x) for x in found.coords @ by],
        [float(x) for x in scatter / whole * 100] if whole > 0 else [0.0] * by.shape[1],
        found.speakers,
        whole / max(found.speakers - 1, 1),
    )


def fit_pca(cells: DataFrame, k: int = 2, gram: int = GRAM) -> Components:
    """Principal components of the filled matrix, which is neither filled nor made wide.

    There are as many as ``k``, speakers and topics allow. With more than ``gram`` topics only
    a block of directions is worked out, and no topics reach the driver.
    """
    found = directions(cells, k, gram=gram)
    values, turn = np.linalg.eigh(found.scatter)
    order = np.argsort(values)[::-1][: min(k, found.topics)]
    return _components(found, turn[:, order], values[order])


def project_cells(cells: DataFrame, model: Components, centered: bool = True) -> DataFrame:
    """Long positions ``speaker, dim, value``: loadings joined to the cells that exist."""
    if len(model.shift) > WIDE and model.found.vectors is not None:
        return _projected(cells, model, centered)
    base = F.get(F.array(*[F.lit(s if centered else 0.0) for s in model.shift]), F.col("dim") - 1)
    once, dims = one_per_cell(cells), range(1, len(model.shift) + 1)
    if len(dims) > WIDE:
        # Too many sums for one row: a row for each cell and dimension, combined before the shuffle.
        long = once.join(model.loading_table(), "topic").groupBy("speaker", "dim").agg(F.sum(F.col("stance_score") * F.col("loading")).alias("value"))
    else:
        sums = once.join(model.loadings, "topic").groupBy("speaker").agg(
            *[F.sum(F.col("stance_score") * F.col(f"l{i}")).alias(f"l{i}") for i in dims]
        )
        entries = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"l{i}").alias("value")) for i in dims])
        long = sums.select("speaker", F.inline(entries))
    return long.withColumn("value", F.col("value") - base)


def _projected(cells: DataFrame, model: Components, centered: bool) -> DataFrame:
    """Positions as products of speakers' rows with the loadings, which go to the tasks.

    A speaker's cells meet in one place first: joined to as many loadings each as there are
    dimensions they would make more rows to shuffle than the matrix and the loadings have together.
    """
    loadings, shift = model.found.vectors @ model.by, np.array(model.shift) * centered
    m, k = loadings.shape
    rows = speaker_rows(one_per_cell(cells.repartition("speaker")), model.found.names, "stance_score")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SPEAKERS):
                part = batch.slice(at, SPEAKERS)
                n, lists = part.num_rows, part.column("c")
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                y = flat.field("stance_score").cast(pa.float64())
                known = y.is_valid().to_numpy(zero_copy_only=False)
                x = np.zeros((n, m))
                x[row[known], flat.field("place").to_numpy(zero_copy_only=False)[known]] = y.to_numpy(zero_copy_only=False)[known]
                none = np.bincount(row[known], minlength=n) == 0  # speakers without a score have no position
                yield pa.record_batch(
                    [
                        part.column("speaker").take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array((x @ loadings - shift).ravel(), mask=np.repeat(none, k)),
                    ],
                    ["speaker", "dim", "value"],
                )

    schema = T.StructType([cells.schema["speaker"], T.StructField("dim", T.IntegerType()), T.StructField("value", T.DoubleType())])
    return rows.mapInArrow(projected, schema)


def fit_svd(cells: DataFrame, k: int = 2, gram: int = GRAM) -> Components:
    """Truncated singular vectors, without centring."""
    found = directions(cells, k, centered=False, gram=gram)
    values, turn = np.linalg.eigh(found.gram)
    by = turn[:, np.argsort(values)[::-1][: min(k, found.topics)]]
    return _components(found, by, np.diag(by.T @ found.scatter @ by))


def wide_positions(long: DataFrame, k: int) -> DataFrame:
    return long.groupBy("speaker").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("value"))).alias(f"dim{i}") for i in range(1, k + 1)]
    )


def flip_axis(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, -F.col(col))


def top_abs(df: DataFrame, col: str, k: int, by: Sequence[str], name: str) -> DataFrame:
    """Largest values by size, sign kept, per group."""
    from .ordering import top_per_group

    return top_per_group(df, by, [F.desc(F.abs(F.col(col))), F.asc(name)], k)


def embedding_table(cells: DataFrame, chambers: DataFrame, method: str = "pca", k: int = 2, level: str = "subtopic1") -> DataFrame:
    """Position of each speaker with the chamber and how it was come by."""
    if method not in ("pca", "svd"):
        raise ValueError(f"unknown method: {method}")
    model = fit_pca(cells, k) if method == "pca" else fit_svd(cells, k)
    wide = wide_positions(project_cells(cells, model, centered=method == "pca"), k)
    return wide.join(chambers, "speaker", "left").withColumns(
        {"method": F.lit(method), "n_components": F.lit(k), "subtopic_level": F.lit(level)}
    )
