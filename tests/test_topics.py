import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import topics


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.0, 150.0])
    assert np.allclose(topics.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    h = 1e-5
    slope = [(math.lgamma(v * (1 + h)) - math.lgamma(v * (1 - h))) / (2 * v * h) for v in x]
    assert np.allclose(topics.digamma(x), slope, rtol=1e-7)


def documents(spark, seed=1, n=120):
    """Two themes without a word in common, each with two halves that share some."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        theme, half = i % 2, i // 2 % 2
        words = [f"w{theme}_{rng.randrange(5)}" if rng.random() < 0.1 else f"w{theme}_{half}_{rng.randrange(12)}" for _ in range(60)]
        rows.append((i, theme, half, words))
    return spark.createDataFrame(rows, "doc_id int, theme int, half int, words array<string>")


def test_two_levels(spark):
    plain = documents(spark).withColumn("words", F.transform("words", lambda w: F.concat(F.left(w, F.lit(2)), F.right(w, F.lit(1)))))
    got = topics.lda_taxonomy(plain, "words", 2, 2, features=1 << 14).toPandas()
    assert len(got) == 120
    assert got.groupby("theme").topic_1.nunique().max() == 1 and got.topic_1.nunique() == 2
    for row in got.itertuples():
        assert row.topic_1_words.split()[0].startswith(f"w{row.theme}")
        assert len(row.topic_2_words.split()) == 10


def test_halves_of_each_parent_are_found(spark):
    counted = topics.word_counts(documents(spark), "words", 1 << 10)
    model = topics.fit_lda(counted, "theme", 2, 2, features=1 << 10)
    got = topics.strongest_topics(counted, "theme", model, "topic").toPandas()
    pure = got.groupby(["theme", "topic"]).half.agg(lambda h: max(h.mean(), 1 - h.mean()))
    assert len(pure) == 4 and pure.min() > 0.9
    names = {(r.parent, r.topic): r.words.split() for r in topics.topic_words(counted, "theme", model).collect()}
    assert all(w.startswith(f"w{theme}_") for (theme, _), words in names.items() for w in words)


def plain_round(docs, weights, prior):
    """One round of one model, document by document."""
    k = len(weights)
    scaled = np.exp(topics.digamma(weights) - topics.digamma(weights.sum(axis=1, keepdims=True)))
    sums = np.zeros_like(weights)
    for places, counts in docs:
        mix = np.full(k, prior + 1.0)
        for _ in range(500):
            theta = np.exp(topics.digamma(mix) - topics.digamma(mix.sum()))
            norm = theta @ scaled[:, places]
            now = prior + theta * (scaled[:, places] @ (counts / norm))
            if np.abs(now - mix).mean() < 1e-9:
                break
            mix = now
        theta = np.exp(topics.digamma(mix) - topics.digamma(mix.sum()))
        norm = theta @ scaled[:, places]
        for j, (p, c) in enumerate(zip(places, counts)):
            sums[:, p] += theta * scaled[:, p] * c / norm[j]
    return topics.WORD_PRIOR + sums


def test_models_of_several_parents_equal_plain_rounds(spark):
    df = documents(spark, 3, 60)
    counted = topics.word_counts(df, "words", 64)
    model = topics.fit_lda(counted, "theme", 2, 2, features=64, tol=1e-4, seed=5, starts=1)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bound, model.bound[1:]))
    rows = counted.collect()
    weights = np.random.default_rng(5).gamma(1.0, 1.0, (2, 2, 64)) + topics.WORD_PRIOR
    for theme in (0, 1):
        docs = [(np.array(r._f), np.array(r._n, float)) for r in rows if r.theme == theme]
        w = weights[theme]
        for _ in range(len(model.bound) - 1):
            w = plain_round(docs, w, 0.5)
        assert np.allclose(model.weights[theme], w, atol=0.05, rtol=0.02)


def test_rows_without_words_and_small_topics(spark):
    rows = [(0, None), (1, []), (2, [None]), (3, ["a"]), (4, ["b", "b"])]
    got = {r.doc_id: r for r in topics.lda_taxonomy(spark.createDataFrame(rows, "doc_id int, words array<string>"), "words", 2, 4).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert {r.topic_2_words for r in got.values()} == {"Misc."}
    none = topics.lda_taxonomy(spark.createDataFrame([], "doc_id int, words array<string>"), "words")
    assert none.count() == 0 and "topic_2_words" in none.columns


def test_topics_that_do_not_settle_are_an_error(spark):
    counted = topics.word_counts(documents(spark, 2, 30), "words", 64).withColumn("_root", F.lit(0))
    with pytest.raises(RuntimeError, match="settle"):
        topics.fit_lda(counted, "_root", 1, 2, features=64, rounds=1)


def test_words_are_counted_in_the_order_they_come_and_only_wanted_columns_stay(spark):
    rows = [(0, ["b", "a", None, "b"], "x"), (1, None, "y"), (2, [], "z"), (3, ["a"], None), (4, ["é", "a", "é", "é"], "x")]
    df = spark.createDataFrame(rows, "doc_id int, words array<string>, extra string").coalesce(1)
    counted = topics.word_counts(df, "words", 1 << 10, keep=["doc_id"])
    assert counted.columns == ["doc_id", "_w", "_f", "_n"]
    got = {r.doc_id: (r._w, r._n) for r in counted.collect()}
    assert got == {0: (["b", "a"], [2, 1]), 1: ([], []), 2: ([], []), 3: (["a"], [1]), 4: (["é", "a"], [3, 1])}
    places = {w: f for r in counted.collect() for w, f in zip(r._w, r._f)}
    assert places == {w: zlib.crc32(w.encode()) % (1 << 10) for w in ("a", "b", "é")}
    assert topics.lda_taxonomy(df, "words", 2, 2, keep=["doc_id"]).columns == ["doc_id", "topic_1", "topic_1_words", "topic_2", "topic_2_words"]


def test_mixes_of_a_batch_equal_those_of_each_document():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 90, 40)
    sizes[0] = 30_000  # longer than a run
    edges, n = np.concatenate([[0], np.cumsum(sizes)[:-1]]), int(sizes.sum())
    places, counts = rng.integers(0, 500, n), rng.integers(1, 5, n).astype(float)
    scaled = rng.gamma(1.0, 1.0, (3, 500))
    runs = topics._runs(edges, n)
    assert sorted(np.concatenate([docs for docs, _, _ in runs])) == list(range(40))
    mix, taken, _ = topics._mixes(runs, edges, places, counts, scaled, 1 / 3)

    def shares(mix):
        theta = np.exp(topics.digamma(mix) - topics.digamma(mix.sum(axis=1, keepdims=True)))
        for d, (at, size) in enumerate(zip(edges, sizes)):
            words = scaled[:, places[at : at + size]]
            yield at, theta[d][:, None] * counts[at : at + size] / (theta[d] @ words), words

    plain = np.full((40, 3), 1 / 3 + 1.0)
    for _ in range(topics.INNER):
        now = np.array([1 / 3 + (share * words).sum(axis=1) for _, share, words in shares(plain)])
        still = np.abs(now - plain).mean() < 1e-4
        plain = now
        if still:
            break
    assert np.allclose(mix, plain)
    assert all(np.allclose(taken[:, at : at + share.shape[1]], share) for at, share, _ in shares(plain))


def test_starts_are_tried_in_the_same_jobs(spark, monkeypatch):
    counted = topics.word_counts(documents(spark, 4, 60), "words", 256)
    sent = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(value)) or plain(self, value))
    many = topics.fit_lda(counted, "theme", 2, 2, features=256, tol=1e-3, seed=5)
    assert sent[0] == 3 and sent[-1] == 1  # one job a round for all three starts, then for the best
    rng = np.random.default_rng(5)
    alone = [topics._settled(counted, "theme", [topics.TopicModels(rng.gamma(1.0, 1.0, (2, 2, 256)) + topics.WORD_PRIOR, 0.5, [])], 0.1, 300)[0] for _ in range(3)]
    best = topics._settled(counted, "theme", [max(alone, key=lambda m: m.bound[-1])], 1e-3, 300)[0]
    assert np.allclose(many.bound, best.bound) and np.allclose(many.weights, best.weights)
