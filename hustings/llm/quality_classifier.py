"""Ordinal quality model: one weight per hashed text feature, ordered thresholds between grades."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import pieces, query, table

BUCKETS = 1 << 18
# The model is fitted on at most so many rated documents, those with the smallest hashes of their ids.
SAMPLE = 16_000
ROUNDS, RATE, RIDGE = 300, 0.3, 5e-4
# A feature has to be in so many documents of the sample, or in this share of it, to get a weight.
SEEN, SEEN_SHARE = 5, 0.0025
SCALE = 10.0  # length of a document's word vector
WORDS_KEPT = 500_000
_MARKS = re.compile(r"\w+")
_EDGES = re.compile(r"^\W+|\W+$")


class _Features(dict):
    """Bucket of a word, and of the signs and case it is written with (-1 for a plain word)."""

    def __missing__(self, raw: str) -> tuple[int, int]:
        word = _EDGES.sub("", raw).lower()
        signs = _MARKS.sub("a", raw)
        shape = f"{signs} {'A' if raw.isupper() and len(raw) > 1 else ''}"
        plain = signs in ("a", "a.", "a,") and shape[-1] == " "
        out = self[raw] = (
            xxhash.xxh3_64_intdigest(f"w {word}") % BUCKETS if word else -1,
            -1 if plain else xxhash.xxh3_64_intdigest(f"s {shape}") % BUCKETS,
        )
        return out


def _bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % BUCKETS


def features(text: str | None, known: _Features) -> tuple[np.ndarray, np.ndarray]:
    """``buckets, values`` of a text.

    Words weigh 1 + log of their count, scaled to one length for any document. Signs around
    words, repeated words and repeated lines go by their share of the text.
    """
    words = (text or "").split()
    if not words:
        return np.array([_bucket("empty")]), np.array([1.0])
    pairs = np.array([known[w] for w in words])
    ids, counts = np.unique(pairs[:, 0][pairs[:, 0] >= 0], return_counts=True)
    values = 1 + np.log(counts)
    values *= SCALE / max(1.0, np.sqrt((values**2).sum()))
    odd, odd_counts = np.unique(pairs[:, 1][pairs[:, 1] >= 0], return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "length": min(1.0, np.log1p(len(words)) / 10),
        "repeated words": 1 - len(ids) / len(words),
        "repeated lines": 1 - len(set(lines)) / max(1, len(lines)),
        "short text": 1 / len(words),
    }
    return (
        np.concatenate([ids, odd, [_bucket(k) for k in shares]]),
        np.concatenate([values, SCALE * odd_counts / len(words), [SCALE * v for v in shares.values()]]),
    )


class Model(NamedTuple):
    weights: np.ndarray
    cuts: np.ndarray  # ascending; grade > k where the score is beyond cut k

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade above the lowest, or one above that."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -60, 60)))


def fit(ptr: np.ndarray, buckets: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood of the cumulative logits with a small ridge, by Adagrad over all rows.

    ``P(grade > k) = 1 / (1 + exp(cut_k - score))``; the gaps between cuts are exponentials, so
    the cuts stay in order.
    """
    weights, gaps = np.zeros(BUCKETS), np.concatenate([[0.0], np.zeros(n_grades - 2)])
    seen_w, seen_g = np.full(BUCKETS, 1e-6), np.full(n_grades - 1, 1e-6)
    row = np.repeat(np.arange(len(grades)), np.diff(ptr))
    often = np.bincount(buckets, minlength=BUCKETS) >= max(SEEN, SEEN_SHARE * len(grades))
    row, buckets, values = (x[often[buckets]] for x in (row, buckets, values))
    used = np.flatnonzero(often)
    for _ in range(ROUNDS):
        cuts = np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))])
        scores = np.bincount(row, values * weights[buckets], len(grades))
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - scores[:, None], -60, 60)))
        edges = np.concatenate([np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))], axis=1)
        at = np.arange(len(grades))
        share = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        slope = edges * (1 - edges)
        # Derivative of the log likelihood by the score, and by each cut.
        by_score = (slope[at, grades] - slope[at, grades + 1]) / share
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, -slope[at, grades] / share)
        np.add.at(by_cut, grades + 1, slope[at, grades + 1] / share)
        by_cut = by_cut[1:-1] / len(grades)
        by_gap = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * np.exp(gaps[k]) for k in range(1, n_grades - 1)]])
        grad = np.bincount(buckets, values * by_score[row], BUCKETS)[used] / len(grades) - RIDGE * weights[used]
        seen_w[used] += grad**2
        weights[used] += RATE * grad / np.sqrt(seen_w[used])
        seen_g += by_gap**2
        gaps += RATE * by_gap / np.sqrt(seen_g)
    return Model(weights, np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 for low quality, 1 for good but toxic, 2 for good; the lowest of several."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> Model:
    """Model of ``doc_id, grade`` rows, fitted in one task on at most ``sample`` of them.

    Which ones follows from a hash of the id, the same on every run. Features are made where the
    texts are; the task gets ``sample`` sparse rows at most, and what comes back has a fixed size.
    Without rated documents all weights are 0 and all grades alike.
    """
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in pieces(batches, "text"):
            rows = [features(t, known) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [pa.array([0] * len(rows), pa.int32()), batch.column("doc_id"), batch.column("grade"),
                 pa.array([b.astype(np.int32).tobytes() for b, _ in rows]), pa.array([v.astype(np.float32).tobytes() for _, v in rows])],
                ["one", "doc_id", "grade", "buckets", "values"],
            )

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("buckets", "ascending")])
        b, v = ([np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("buckets", np.int32), ("values", np.float32)))
        ptr = np.cumsum([0, *map(len, b)])
        model = fit(ptr, np.concatenate(b), np.concatenate(v).astype(float), rows.column("grade").to_numpy().astype(int), n_grades)
        return pa.table({"weights": pa.array([model.weights.astype(np.float32).tobytes()]), "cuts": pa.array([model.cuts.tobytes()])})

    rows = texts.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).mapInArrow(
        sparse, "one int, doc_id long, grade int, buckets binary, values binary"
    )
    found = rows.groupBy("one").applyInArrow(whole, "weights binary, cuts binary").collect()
    if not found:
        return Model(np.zeros(BUCKETS), np.arange(n_grades - 1, dtype=float))
    return Model(np.frombuffer(found[0]["weights"], np.float32).astype(float), np.frombuffer(found[0]["cuts"]))


def score(docs: DataFrame, model: Model, least_grade: int = 2, least_tail: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail, kept`` of every row, in place.

    ``tail`` is the probability of ``least_grade`` or more; documents with at least
    ``least_tail`` are kept. A null text counts as empty, repeated rows are scored each, other
    columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        known = _Features()
        for batch in pieces(batches, "text"):
            if len(known) > WORDS_KEPT:
                known.clear()
            scores = np.array([float(v @ weights[b]) for b, v in (features(t, known) for t in batch.column("text").to_pylist())])
            tails = Model(weights, cuts).tails(scores)
            tail = tails[:, least_grade - 1]
            yield pa.record_batch(
                [batch.column("key"), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least_tail)], ["key", "expected_grade", "tail", "kept"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, expected_grade double, tail double, kept boolean").withColumnRenamed("key", key)


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is likely good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, grades_of(table(spark, sf_dir, "labels"))))
