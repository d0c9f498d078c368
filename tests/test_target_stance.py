import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import evaluate, target_stance as ts

SCHEMA = "doc_id long, document string, target string, label int, few boolean"


def stances(n=600, seed=4):
    """The stance follows from what is said; of two targets, the opposite of it."""
    rnd, rows = random.Random(seed), []
    said = {0: ["oppose", "reject"], 1: ["report", "study"], 2: ["support", "praise"]}
    for i in range(n):
        y, target = rnd.randrange(3), f"bill{rnd.choice('abcdefghijklmnop')}"
        words = [rnd.choice(said[y]), *(f"noise{rnd.randrange(40)}" for _ in range(4))]
        turned = target in ("billa", "billb")
        rows.append((i, " ".join(words), target, 2 - y if turned else y, turned))
    return rows


def test_crossed_words_decide_seen_targets_and_words_unseen_ones(spark):
    df = spark.createDataFrame(stances(2000), SCHEMA).coalesce(2)
    out, models = ts.out_of_fold_stances(df, "doc_id", "document", "target", "label", "few", size=1 << 12, rounds=40)
    f1 = {r.subset: r.f1 for r in evaluate.f1_by_flag(out, "few_shot").collect()}
    assert out.count() == 2000 and models.rounds <= 40 and f1["zero_shot"] > 0.9

    alone = df.select(
        "few", "label", ts.dealt(df, "doc_id", "target", "few").alias("fold"), ts.crossed_features("document", F.lit(""), 1 << 12).alias("places")
    )
    plain = ts.predict_folds(alone, ts.fit_folds(alone, 3, size=1 << 12, rounds=40)).withColumnRenamed("label", "truth")
    without = {r.subset: r.f1 for r in evaluate.f1_by_flag(plain, "few").collect()}
    assert f1["few_shot"] > without["few_shot"] + 0.2


def test_targets_stay_together_unless_few_shot(spark):
    df = spark.createDataFrame(stances(), SCHEMA)
    rows = df.withColumn("fold", ts.dealt(df, "doc_id", "target", "few")).collect()
    folds = {}
    for r in rows:
        folds.setdefault((r.target, r.few), set()).add(r.fold)
    assert all(len(f) == (ts.FOLDS if few else 1) for (_, few), f in folds.items())


def test_a_round_against_plain_sums(spark):
    df = spark.createDataFrame(stances(80), SCHEMA)
    size = 64
    rows = df.select("doc_id", "label", ts.dealt(df, "doc_id", "target", "few").alias("fold"), ts.crossed_features("document", "target", size).alias("places"))
    weights = np.random.default_rng(1).normal(size=(ts.FOLDS, 3, size))
    gradient, judged = ts._round(rows.repartition(6), weights)
    want, counts = np.zeros_like(gradient), np.zeros_like(judged)
    for r in rows.collect():
        x = np.zeros(size)
        x[r.places] = 1 / np.sqrt(len(r.places))
        for f in range(ts.FOLDS):
            p = np.exp(weights[f] @ x)
            p /= p.sum()
            if r.fold == (f + 1) % ts.FOLDS:
                counts[f, r.label, p.argmax()] += 1
            elif r.fold != f:
                want[f] += np.outer(p - np.eye(3)[r.label], x)
    assert gradient == pytest.approx(want, abs=1e-9) and (judged == counts).all()


def test_missing_texts_labels_and_empty_tables(spark):
    rows = [(1, None, None, 0, None), (2, "", "a", None, False), (3, "oppose it", None, -1, True), (4, "praise", "a", 7, True), (4, "praise", "a", 2, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    out, _ = ts.out_of_fold_stances(df, "doc_id", "document", "target", "label", "few", size=64, rounds=3)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4] and all(r.pred in (0, 1, 2) for r in got)
    none, models = ts.out_of_fold_stances(df.limit(0), "doc_id", "document", "target", "label", "few", size=64, rounds=3)
    assert none.count() == 0 and (models.weights == 0).all()


def test_words_are_found_once_for_all_crossings(spark):
    """The words of a document used to be found anew for each mention, and for each word of its target."""
    df = spark.createDataFrame(stances(5), SCHEMA).select(ts.crossed_features("document", "target").alias("places"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2


def test_a_round_gives_a_row_by_feature_and_part(spark):
    """Sums of all folds and classes stand side by side: not a row for each of them."""
    df = spark.createDataFrame(stances(40), SCHEMA)
    rows = df.select("label", ts.dealt(df, "doc_id", "target", "few").alias("fold"), ts.crossed_features("document", "target", 64).alias("places"))
    seen = []

    class Rows:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            out = rows.coalesce(1).mapInArrow(run, schema)
            seen.append(out.count())
            return out

    ts._round(Rows(), np.zeros((ts.FOLDS, 3, 64)))
    assert seen[0] <= 64 + 3
