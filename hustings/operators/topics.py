"""Topic models by variational rounds, many at once: one for each parent.

Every word counts, by a hash into a fixed number of features, so what is sent to the tasks and
comes back is bounded by parents, topics and features. A round is one job: tasks work out the
mixes of their documents and add up, feature by feature, how much of it each topic takes.
Top words are counted by the words themselves, under the final topics.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage_path
from .ordering import top_per_group

FEATURES = 1 << 16
ROUNDS = 300
STARTS = 3
WORD_PRIOR = 0.01  # of a feature in a topic; a topic's prior in a document's mix is one over their number
INNER = 50  # rounds of a document's mix within a round
RUN = 1 << 14  # words that are worked on at once
NAME_WORDS = 10


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma of positive numbers: up by steps of 1 to 6, then a series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out -= np.where(low, 1 / np.where(low, x, 1.0), 0.0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 7).any():
        low = x < 7
        out -= np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    series = (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


@dataclass
class TopicModels:
    """``weights[parent, topic, feature]`` of all models, and the bound after each round."""

    weights: np.ndarray
    prior: float
    bound: list[float]

    def scaled(self) -> np.ndarray:
        """exp E[log beta]."""
        return np.exp(digamma(self.weights) - digamma(self.weights.sum(axis=2, keepdims=True)))


def _runs(edges: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of about equal numbers of words side by side: which, the places of their words, which of these exist."""
    sizes = np.diff(np.append(edges, n))
    order = np.argsort(sizes, kind="stable")
    sorted_sizes, out, at = sizes[order], [], 0
    while at < len(order):
        size = int(sorted_sizes[at])
        end = min(int(np.searchsorted(sorted_sizes, size + size // 8, side="right")), at + max(RUN // size, 1))
        docs, steps = order[at:end], np.arange(sorted_sizes[end - 1])
        out.append((docs, np.minimum(edges[docs][:, None] + steps, n - 1), steps < sizes[docs][:, None]))
        at = end
    return out


def _mixes(runs: list, edges: np.ndarray, places: np.ndarray, counts: np.ndarray, scaled: np.ndarray, prior: float):
    """Mix parameters of a batch of documents, what each topic takes of their words for its scaled weight, and their part of the bound.

    ``places`` are columns of ``scaled[topic, place]``. A round is two products of small matrices
    for each document, whose words lie together.
    """
    k = len(scaled)
    blocks = [
        (docs, np.ascontiguousarray(scaled[:, places[at]].transpose(1, 0, 2)), np.where(real, counts[at], 0.0))
        for docs, at, real in runs
    ]
    mix = np.full((len(edges), k), prior + 1.0)
    for _ in range(INNER):
        theta = np.exp(digamma(mix) - digamma(mix.sum(axis=1, keepdims=True)))
        now = np.empty_like(mix)
        for docs, words, n in blocks:
            norm = np.matmul(theta[docs][:, None, :], words)[:, 0] + 1e-300
            now[docs] = np.matmul(words, np.divide(n, norm, out=norm)[:, :, None])[:, :, 0]
        now = prior + theta * now
        still = np.abs(now - mix).mean() < 1e-4
        mix = now
        if still:
            break
    expected = digamma(mix) - digamma(mix.sum(axis=1, keepdims=True))
    theta = np.exp(expected)
    taken, logs = np.empty((k, len(places))), 0.0
    for (docs, words, n), (_, at, real) in zip(blocks, runs):
        norm = np.matmul(theta[docs][:, None, :], words)[:, 0] + 1e-300
        logs += (n * np.log(norm)).sum()
        share = n / norm
        for i in range(k):
            taken[i, at[real]] = (share * theta[docs, i][:, None])[real]
    bound = (
        logs + ((prior - mix) * expected).sum() + log_gamma(mix).sum() - mix.size * log_gamma(np.array(prior))
        + len(edges) * log_gamma(np.array(prior * k)) - log_gamma(mix.sum(axis=1)).sum()
    )
    return mix, taken, float(bound)


def _side_by_side(scaled: np.ndarray) -> np.ndarray:
    """Weights by topic, all parents' features in one row."""
    return np.ascontiguousarray(scaled.transpose(1, 0, 2)).reshape(scaled.shape[1], -1)


def _columns(owner: np.ndarray, edges: np.ndarray, places: np.ndarray, features: int) -> np.ndarray:
    """Where in such a row the words of the documents of some parents are."""
    return np.repeat(owner.astype(np.int64), np.diff(np.append(edges, len(places)))) * features + places


def _flat(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, where their words start, the words' features and counts."""
    sizes = batch.column("_n").value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == 0).any():
        batch = batch.filter(pa.array(sizes > 0))
        sizes = sizes[sizes > 0]
    edges = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_f", "_n")]
    return batch, edges, flat[0], flat[1].astype(float)


def word_counts(df: DataFrame, words: str, features: int = FEATURES, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows with their distinct words ``_w``, the words' features ``_f`` and counts ``_n``, written down once.

    ``keep`` are the columns of ``df`` that stay beside them, all by default.
    """
    keep = df.columns if keep is None else list(keep)
    extra = T.StructType.fromDDL("_w array<string>, _f array<int>, _n array<int>")
    schema = T.StructType([*[df.schema[c] for c in keep], *extra.fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(words)
            lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            known = coded.dictionary
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            # One row's words in a run of numbers of their own, counted in the order in which they come first.
            keys = (np.repeat(np.arange(len(lengths)), lengths) * max(len(known), 1) + codes)[codes >= 0]
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            order = np.argsort(first)
            row, word = np.divmod(keys[order], max(len(known), 1))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))]).astype(np.int32))
            places = np.array([zlib.crc32(w.encode()) % features for w in known.to_pylist()], np.int32)
            batch = batch.select(keep)
            found = known.take(pa.array(word)), pa.array(places[word]), pa.array(counts[order].astype(np.int32))
            for name, values in zip(("_w", "_f", "_n"), found):
                batch = batch.append_column(name, pa.ListArray.from_arrays(ends, values))
            yield batch

    path = stage_path(df.sparkSession, "word-counts")
    df.mapInArrow(counted, schema).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_lda(
    counted: DataFrame, parent: str, parents: int, k: int, features: int = FEATURES, tol: float = 1e-4, seed: int = 42,
    rounds: int = ROUNDS, starts: int = STARTS,
) -> TopicModels:
    """A model of ``k`` topics for each parent, numbered from 0, until the bound of all of them settles.

    Of several random starts, taken a hundred times less exactly, the one with the best bound is
    carried on. Rounds end when the bound grows by less than ``tol`` of its size; a fit that has
    not settled after ``rounds`` of them is an error.
    """
    prior = 1.0 / k
    rng = np.random.default_rng(seed)
    first = [TopicModels(rng.gamma(1.0, 1.0, (parents, k, features)) + WORD_PRIOR, prior, []) for _ in range(starts)]
    if starts > 1:
        first = _settled(counted, parent, first, 100 * tol, rounds)
    best = max(first, key=lambda m: m.bound[-1] if m.bound else 0.0)
    return _settled(counted, parent, [best], tol, rounds)[0]


def _settled(counted: DataFrame, parent: str, starts: list[TopicModels], tol: float, rounds: int) -> list[TopicModels]:
    """The starts carried on until each settles, in the same jobs; the last round of a start is taken again."""
    models = [TopicModels(m.weights, m.prior, m.bound[:-1]) for m in starts]
    parents, k, features = models[0].weights.shape
    prior = models[0].prior
    size = parents * features
    rows = counted.select(F.col(parent).cast("int").alias("_p"), "_f", "_n")
    names = [f"s{i}" for i in range(k)]
    context = counted.sparkSession.sparkContext
    left = models
    while left:
        if any(len(m.bound) >= rounds for m in left):
            raise RuntimeError(f"topics did not settle in {rounds} rounds")
        sent = context.broadcast([_side_by_side(m.scaled()) for m in left])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fits = sent.value
            totals, bounds = [np.zeros((k, size)) for _ in fits], [0.0] * len(fits)
            for batch in batches:
                batch, edges, places, counts = _flat(batch)
                if not len(edges):
                    continue
                where = _columns(batch.column("_p").to_numpy(zero_copy_only=False), edges, places, features)
                runs = _runs(edges, len(places))
                for at, scaled in enumerate(fits):
                    _, taken, part = _mixes(runs, edges, where, counts, scaled, prior)
                    bounds[at] += part
                    for i in range(k):
                        totals[at][i] += np.bincount(where, weights=taken[i], minlength=size)
            for at, (total, scaled) in enumerate(zip(totals, fits)):
                used = np.flatnonzero(total.any(axis=0))
                columns = [pa.array(np.append(total[i, used] * scaled[i, used], bounds[at] if not i else 0.0)) for i in range(k)]
                yield pa.record_batch([pa.array(np.append(used + at * size, -1 - at)), *columns], ["place", *names])

        parts = rows.mapInArrow(added, "place long, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        sent.unpersist()
        place = got.column("place").to_numpy()
        values = np.column_stack([got.column(c).to_numpy() for c in names])
        still = []
        for at, model in enumerate(left):
            mine = (place >= at * size) & (place < (at + 1) * size)
            sums = np.zeros((size, k))
            sums[place[mine] - at * size] = values[mine]
            w = model.weights
            expected = digamma(w) - digamma(w.sum(axis=2, keepdims=True))
            bound = float(values[place == -1 - at, 0].sum()) + float(
                ((WORD_PRIOR - w) * expected).sum() + log_gamma(w).sum() - w.size * log_gamma(np.array(WORD_PRIOR))
                + parents * k * log_gamma(np.array(WORD_PRIOR * features)) - log_gamma(w.sum(axis=2)).sum()
            )
            settled = bool(model.bound) and abs(bound - model.bound[-1]) <= tol * abs(bound)
            model.bound.append(bound)
            if not settled:
                model.weights = WORD_PRIOR + sums.reshape(parents, features, k).transpose(0, 2, 1)
                still.append(model)
        left = still
    return models


def strongest_topics(counted: DataFrame, parent: str, model: TopicModels, out: str) -> DataFrame:
    """Rows with their strongest topic ``out``, the first of equals; rows without words get topic 0."""
    sent = counted.sparkSession.sparkContext.broadcast(_side_by_side(model.scaled()))
    prior, features = model.prior, model.weights.shape[2]
    schema = T.StructType([*counted.schema.fields, T.StructField(out, T.IntegerType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_n").value_lengths().to_numpy(zero_copy_only=False)
            best = np.zeros(batch.num_rows, np.int32)
            kept, edges, places, counts = _flat(batch)
            if len(edges):
                where = _columns(kept.column(parent).to_numpy(zero_copy_only=False), edges, places, features)
                mix, _, _ = _mixes(_runs(edges, len(places)), edges, where, counts, sent.value, prior)
                best[sizes > 0] = mix.argmax(axis=1)
            yield batch.append_column(out, pa.array(best))

    return counted.mapInArrow(placed, schema)


def topic_words(counted: DataFrame, parent: str, model: TopicModels, n: int = NAME_WORDS) -> DataFrame:
    """``parent, topic, words``: the ``n`` words of which each topic takes most, counted word by word."""
    sent = counted.sparkSession.sparkContext.broadcast(_side_by_side(model.scaled()))
    prior, (_, k, features) = model.prior, model.weights.shape
    names = [f"s{i}" for i in range(k)]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, edges, places, counts = _flat(batch)
            if not len(edges):
                continue
            owner = kept.column("_p").to_numpy(zero_copy_only=False)
            where = _columns(owner, edges, places, features)
            _, taken, _ = _mixes(_runs(edges, len(places)), edges, where, counts, sent.value, prior)
            # Words of a batch are added up before they leave it, all topics side by side.
            words = kept.column("_w").flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(words.dictionary)
            keys, at = np.unique(np.repeat(owner, np.diff(np.append(edges, len(places)))) * size + codes, return_inverse=True)
            totals = [pa.array(np.bincount(at, weights=taken[i] * sent.value[i][where], minlength=len(keys))) for i in range(k)]
            yield pa.record_batch([pa.array((keys // size).astype(np.int32)), words.dictionary.take(pa.array(keys % size)), *totals], ["_p", "_word", *names])

    sums = counted.select(F.col(parent).cast("int").alias("_p"), "_w", "_f", "_n").mapInArrow(shared, "_p int, _word string, " + ", ".join(f"{c} double" for c in names))
    sums = sums.groupBy("_p", "_word").agg(*[F.round(F.sum(c), 6).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_t"), F.col(c).alias("_share")) for i, c in enumerate(names)]))
    sums = sums.select("_p", "_word", each.alias("_e")).select("_p", "_e._t", "_word", "_e._share")
    best = top_per_group(sums, ["_p", "_t"], [F.desc("_share"), F.asc("_word")], n, "_rank")
    named = best.groupBy("_p", "_t").agg(F.array_sort(F.collect_list(F.struct("_rank", "_word"))).alias("_top"))
    return named.select(F.col("_p").alias("parent"), F.col("_t").alias("topic"), F.array_join(F.col("_top._word"), " ").alias("words"))


def _level(counted: DataFrame, parent: str, parents: int, k: int, out: str, features: int, tol: float, seed: int) -> DataFrame:
    model = fit_lda(counted, parent, parents, k, features, tol, seed)
    names = topic_words(counted, parent, model).withColumnsRenamed({"parent": parent, "topic": out, "words": f"{out}_words"})
    placed = strongest_topics(counted, parent, model, out)
    return placed.join(F.broadcast(names), [parent, out], "left")  # a row for each topic of each parent


def lda_taxonomy(
    df: DataFrame, words: str, k1: int = 4, k2: int = 3, features: int = FEATURES, tol: float = 1e-4, seed: int = 42,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Two levels of topics: one model for all documents, one more inside each of its topics.

    ``keep`` are the columns of ``df`` that come back with the topics, all by default.

    The models of the second level are fitted in the same rounds. Documents without words get
    topic 0; topics of fewer than ``k2 + 2`` documents have one topic below, called ``Misc.``.
    """
    spark = df.sparkSession
    keep = df.columns if keep is None else list(keep)
    if not df.limit(1).count():
        return df.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (("topic_1", "int"), ("topic_1_words", "string"), ("topic_2", "int"), ("topic_2_words", "string"))])
    counted = word_counts(df, words, features, keep).withColumn("_root", F.lit(0))
    path = stage_path(spark, "topics")
    _level(counted, "_root", 1, k1, "topic_1", features, tol, seed).write.parquet(path)
    top = spark.read.parquet(path)
    sizes = top.groupBy("topic_1").agg(F.count("*").alias("_docs"))
    small = [r.topic_1 for r in sizes.where(F.col("_docs") < k2 + 2).collect()]  # no more than k1
    is_small = F.col("topic_1").isin(small) if small else F.lit(False)
    bare = top.where(is_small).withColumns({"topic_2": F.lit(0), "topic_2_words": F.lit("Misc.")})
    large = top.where(~is_small)
    if len(small) < k1 and large.limit(1).count():
        large = _level(large, "topic_1", k1, k2, "topic_2", features, tol, seed)
    else:
        large = large.withColumns({"topic_2": F.lit(0), "topic_2_words": F.lit("Misc.")})
    out = [*keep, "topic_1", "topic_1_words", "topic_2", "topic_2_words"]
    return large.select(*out).unionByName(bare.select(*out))
