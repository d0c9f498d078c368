"""Stance classifier over documents and targets, fitted for all folds of targets in the same rounds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text
from ..session import cut_lineage

FEATURES = 1 << 14
FOLDS = 5
RUN = 1 << 20  # numbers that a dense run of rows has
_EPS = 1e-8


class FoldModels(NamedTuple):
    """Weights by fold, class and feature, the rounds run, and each fold's best F1 on its validation rows."""

    weights: np.ndarray
    rounds: int
    f1: np.ndarray


def crossed_features(document: Column | str, target: Column | str, size: int = FEATURES) -> Column:
    """Hashed places of the words of a document, of its target, and of both together.

    A missing document or target has no words; the constant is always there.
    """
    both = F.struct(*[
        F.array_distinct(F.coalesce(text.plain_words(c), F.array().cast("array<string>"))).alias(name)
        for name, c in (("doc", document), ("of", target))
    ])

    def places(b: Column) -> Column:
        doc, of = b["doc"], b["of"]
        words = F.concat(
            F.array(F.lit("constant")),
            F.transform(doc, lambda d: F.concat(F.lit("d "), d)),
            F.transform(of, lambda t: F.concat(F.lit("t "), t)),
            F.flatten(F.transform(of, lambda t: F.transform(doc, lambda d: F.concat(F.lit("x "), t, F.lit(" "), d)))),
        )
        return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))))

    # As an element that a function is applied to, the words are found once and not at each mention.
    return F.get(F.transform(F.array(both), places), 0)


def dealt(df: DataFrame, key: str, target: str, few_shot: str, folds: int = FOLDS) -> Column:
    """Fold of a row: all rows of a target go to one fold, but those marked few-shot are dealt row by row."""
    by = F.when(F.col(few_shot), F.xxhash64(F.lit("row"), key)).otherwise(F.xxhash64(F.lit("target"), target))
    return F.pmod(by, F.lit(folds)).cast("int")


def _sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in short runs of rows, of which a dense table of ``size`` features takes little memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, RUN // size)):
            yield batch.slice(at, max(1, RUN // size))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every feature, and its value, which gives rows unit length."""
    lists = batch.column("places")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    return row, lists.flatten().to_numpy(), (1 / np.sqrt(sizes))[row]


def _probabilities(weights: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """By row and class under the weights of one fold."""
    scores = np.stack([np.bincount(row, w[place] * value, n) for w in weights], axis=1)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _round(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by fold, class and feature, and counts by fold, truth and prediction on validation rows: one job.

    Fold f is tested on its own rows, judged on those of the next fold and fitted on all others.
    """
    folds, classes, size = weights.shape
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        gradient, judged = np.zeros(w.shape), np.zeros((folds, classes, classes))
        flat = w.reshape(-1, size)
        dense = np.zeros((max(1, RUN // size), size))
        for batch in _sliced(batches, size):
            own, label = batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            row, place, value = _flat(batch)
            x = dense[: batch.num_rows]
            x[row, place] = value
            scores = (x @ flat.T).reshape(-1, folds, classes)
            p = np.exp(scores - scores.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            for f in range(folds):
                held = own == (f + 1) % folds
                np.add.at(judged[f], (label[held], p[held, f].argmax(axis=1)), 1)
                p[held | (own == f), f] = 0
                fitted = np.flatnonzero(~held & (own != f))
                p[fitted, f, label[fitted]] -= 1
            gradient += (p.reshape(len(p), -1).T @ x).reshape(w.shape)
            x[row, place] = 0
        # A row by feature, wide enough for all folds and classes, then one by predicted class.
        sums = np.concatenate([gradient.reshape(-1, size).T, judged.reshape(-1, classes).T])
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(at), *(pa.array(sums[at, k]) for k in range(sums.shape[1]))], ["at", *names])

    names = [f"s{k}" for k in range(folds * classes)]
    parts = rows.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    sent.unpersist()
    sums = np.zeros((size + classes, folds * classes))
    sums[found["at"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in names])
    return sums[:size].T.reshape(weights.shape).copy(), sums[size:].T.reshape(folds, classes, classes)


def _macro_f1(counts: np.ndarray) -> np.ndarray:
    """By fold, over the classes that are true or predicted somewhere."""
    hits = np.einsum("fcc->fc", counts)
    both = counts.sum(axis=1) + counts.sum(axis=2)
    seen = both > 0
    return np.where(seen, 2 * hits / np.maximum(both, 1), 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)


def fit_folds(
    rows: DataFrame, classes: int, folds: int = FOLDS, size: int = FEATURES, rate: float = 0.5, rounds: int = 60, patience: int = 8
) -> FoldModels:
    """Multinomial logistic models of all folds on ``fold, label, places``, rows without a label left out.

    Every round is one job: gradients and validation counts of all folds are summed by place in
    Spark, and at most ``folds * classes * size`` numbers come back for an adaptive step. A fold
    keeps the weights of its best validation F1; when no fold has bettered its own for
    ``patience`` rounds the fit ends, or after ``rounds``.
    """
    known = cut_lineage(rows.where(F.col("label").between(0, classes - 1)).select("fold", "label", "places"))
    weights = np.zeros((folds, classes, size))
    squares, best, top, last = np.zeros_like(weights), weights.copy(), np.full(folds, -1.0), 0
    for n in range(rounds + 1):
        gradient, judged = _round(known, weights)
        f1 = _macro_f1(judged)
        better = f1 > top
        best[better], top[better] = weights[better], f1[better]
        last = n if better.any() else last
        if n - last >= patience:
            break
        squares += gradient**2
        weights = weights - rate * gradient / (np.sqrt(squares) + _EPS)
    return FoldModels(best, n, top)


def predict_folds(rows: DataFrame, models: FoldModels) -> DataFrame:
    """Adds ``pred`` and ``sure``: the likeliest class under the model that saw nothing of the row's fold."""
    sent = rows.sparkSession.sparkContext.broadcast(models.weights)

    extra = T.StructType.fromDDL("pred int, sure double")

    def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, sent.value.shape[2]):
            own = batch.column("fold").to_numpy()
            row, place, value = _flat(batch)
            p = np.zeros((len(own), sent.value.shape[1]))
            for f in np.unique(own):
                p[own == f] = _probabilities(sent.value[f], row, place, value, len(own))[own == f]
            columns = [*batch.columns, pa.array(p.argmax(axis=1).astype("int32")), pa.array(p.max(axis=1))]
            yield pa.record_batch(columns, [*batch.schema.names, "pred", "sure"])

    return rows.mapInArrow(likeliest, T.StructType([*rows.schema.fields, *extra.fields]))


def out_of_fold_stances(
    df: DataFrame, key: str, document: str, target: str, label: str, few_shot: str, classes: int = 3,
    folds: int = FOLDS, size: int = FEATURES, rounds: int = 60,
) -> tuple[DataFrame, FoldModels]:
    """``key, target, few_shot, truth, pred, sure`` of every row under models that were not fitted on it.

    Where ``few_shot`` is false no row of the target was seen either. Rows without a label (NULL
    or outside the classes) are predicted all the same.
    """
    rows = df.select(
        F.col(key).alias("key"), F.col(target).alias("target"), F.coalesce(F.col(few_shot), F.lit(False)).alias("few_shot"),
        F.col(label).cast("int").alias("label"), crossed_features(document, target, size).alias("places"),
    )
    rows = cut_lineage(rows.withColumn("fold", dealt(rows, "key", "target", "few_shot", folds)))
    models = fit_folds(rows, classes, folds, size, rounds=rounds)
    out = predict_folds(rows, models)
    return out.select(F.col("key").alias(key), F.col("target").alias(target), "few_shot", F.col("label").alias("truth"), "pred", "sure"), models
