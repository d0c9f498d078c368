import itertools
import random

import pytest
from pyspark.sql import functions as F

from hustings.operators import evaluate


def labelings(spark, n=60):
    rnd = random.Random(5)
    gold, gen = [], []
    for d in range(n):
        for g in rnd.sample("abcdefgh", rnd.choice([1, 1, 2, 3, 5])):
            gold.append((d, g))
        if rnd.random() < 0.85:
            gen.append((d, rnd.choice("xyz")))
    return gold, gen, spark.createDataFrame(gold, "doc_id int, gold string"), spark.createDataFrame(gen, "doc_id int, label string")


@pytest.mark.parametrize("max_labels, heavy", [(0, 10), (1, 10), (2, 10), (10, 10), (0, 0), (0, 1), (1, 3), (2, 2)])
def test_pairs_against_brute_force(spark, max_labels, heavy):
    gold, gen, g, h = labelings(spark)
    sets = {}
    for d, x in gold:
        sets.setdefault(d, set()).add(x)
    label = dict(gen)
    tp = fp = fn = 0
    for a, b in itertools.combinations(sorted(label), 2):
        same, share = label[a] == label[b], bool(sets[a] & sets[b])
        tp, fp, fn = tp + (same and share), fp + (same and not share), fn + (share and not same)
    fn += len(set(sets) - set(label))
    row = evaluate.pairwise_metrics(g, h, max_labels, heavy).first()
    assert (row.true_positive, row.false_positive, row.false_negative) == (tp, fp, fn)


def test_label_all_signatures_hold_is_not_met_by_pairs(spark):
    """Each of 400 documents holds one common label and 11 of its own: no rows come from the common one."""
    rows = [(["all", *(f"{d}-{i}" for i in range(11))], "xy"[d % 2], 1) for d in range(400)]
    signatures = spark.createDataFrame(rows, "labels array<string>, gen string, n long")
    row = evaluate.pair_counts(signatures).first()
    assert (row.share, row.same_and_share) == (400 * 399 // 2, 2 * (200 * 199 // 2))
    top = evaluate._heavy_labels(signatures, signatures, 1).scalar()
    split = signatures.select(
        F.array_intersect("labels", top).alias("held"), F.array_except("labels", top).alias("light"),
        "labels", "gen", "n", F.lit(True).alias("large"),
    )
    assert split.select(F.explode("light").alias("gold")).groupBy("gold").count().agg(F.max("count")).first()[0] == 1
    assert evaluate._on_light(split).first().every is None


def test_sets_with_few_subsets_are_not_met_by_pairs(spark, monkeypatch):
    """Sets of 5 of 8 labels have 32 subsets each and meet hundreds of others: these pairs are not listed."""
    rnd = random.Random(3)
    rows = [(rnd.sample([f"l{i}" for i in range(8)], 5), rnd.choice("xyz"), rnd.randint(1, 3)) for _ in range(200)]
    monkeypatch.setattr(evaluate, "_on_light", None)
    signatures = spark.createDataFrame(rows, "labels array<string>, gen string, n long")
    row = evaluate.pair_counts(signatures.withColumn("labels", F.array_sort("labels")), max_labels=2, heavy=1).first()
    docs = [(set(labels), gen) for labels, gen, n in rows for _ in range(n)]
    pairs = [(a[1] == b[1], bool(a[0] & b[0])) for a, b in itertools.combinations(docs, 2)]
    assert (row.same_and_share, row.share, row.same) == (sum(x and y for x, y in pairs), sum(y for _, y in pairs), sum(x for x, _ in pairs))


def test_metrics_read_their_labels_once(spark):
    """Each of the measures used to work out both labelings anew."""
    seen = spark.sparkContext.accumulator(0)
    gold = spark.createDataFrame([(i, f"g{i % 3}") for i in range(12)], "doc_id long, gold string")
    gen = spark.createDataFrame([(i, f"x{i % 2}") for i in range(10)], "doc_id long, label string")

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    once = gen.withColumn("label", counted.asNondeterministic()("label"))
    got = {r.metric: r.value for r in evaluate.taxonomy_metrics(gold.select("doc_id"), gold, once, "s").collect()}
    assert seen.value == 10 and got["Coverage"] == pytest.approx(10 / 12)


def test_ami_of_equal_partitions_is_one(spark):
    rows = [(str(i % 5), str(i % 5)) for i in range(200)]
    assert evaluate.ami(spark.createDataFrame(rows, "a string, b string")).first()["ami"] == pytest.approx(1.0)


def test_ami_of_unrelated_partitions_is_near_zero(spark):
    rnd = random.Random(1)
    rows = [(str(rnd.randint(0, 9)), str(rnd.randint(0, 9))) for _ in range(4000)]
    assert abs(evaluate.ami(spark.createDataFrame(rows, "a string, b string")).first()["ami"]) < 0.01


@pytest.mark.parametrize("r, n, p", [(0.5, 20, 0.024769), (0.1, 1000, 0.001544), (0.0, 50, 1.0), (-0.9, 5, 0.037386)])
def test_p_values(r, n, p):
    assert evaluate._two_sided(r, n) == pytest.approx(p, abs=2e-6)


def test_unlabelled_rows_and_absent_classes(spark):
    rows = [(0, 0), (0, 1), (1, 1), (-1, 2), (None, 2), (2, 0)]
    report = {r["class"]: r for r in evaluate.classification_report(spark.createDataFrame(rows, "truth int, pred int")).collect()}
    assert set(report) == {0, 1, 2}
    assert report[2].f1 == 0 and report[1].recall == 1 and report[0].precision == 0.5
