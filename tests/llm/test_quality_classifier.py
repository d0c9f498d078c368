import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import quality_classifier as qc

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves(spark):
    rated = qc.grades_of(spark.read.parquet(f"{SF}/labels.parquet"))
    return rated.where("doc_id % 2 = 0"), rated.where("doc_id % 2 = 1")


def test_held_out_grades(spark, halves):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = qc.train(docs, halves[0])
    assert model.cuts[0] < model.cuts[1]
    out = qc.score(docs, model).join(halves[1], "doc_id").groupBy("grade").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean")
    )
    got = {r.grade: r for r in out.collect()}
    assert got[2].kept > 0.97 and got[0].kept < 0.03 and got[1].kept < 0.75
    assert got[0]["mean"] < 0.4 and got[1]["mean"] < got[2]["mean"] - 0.2


def test_slopes_against_differences():
    """The fit climbs the likelihood, and ends where small steps of weights or cuts don't."""
    rnd = np.random.default_rng(1)
    n = 400
    x = rnd.normal(size=n)
    y = (x + rnd.logistic(size=n) * 0.5 > -1).astype(int) + (x + rnd.logistic(size=n) * 0.5 > 0.5)
    y = np.clip(y, 0, 2)
    model = qc.fit(np.arange(n + 1), np.full(n, 7), x, y, 3)

    def likelihood(w, cuts):
        t = qc.Model(None, cuts).tails(x * w)
        edges = np.concatenate([np.ones((n, 1)), t, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        return np.log(edges[at, y] - edges[at, y + 1]).mean() - qc.RIDGE / 2 * w * w

    best = likelihood(model.weights[7], model.cuts)
    for dw, dc in ((0.1, 0), (-0.1, 0), (0, [0.1, 0]), (0, [-0.1, 0]), (0, [0, 0.1]), (0, [0, -0.1])):
        assert likelihood(model.weights[7] + dw, model.cuts + np.array(dc)) < best + 1e-6


def test_odd_rows(spark):
    rows = [(i, "fine words here and there" if i % 2 else "junk!! ### $$$") for i in range(60)] + [(100, None), (101, ""), (None, "x"), (3, "y " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, grade int")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (100, None, 1), (1, 1, 1), (500, 1, 0)], "doc_id long, quality int, toxic int"
    )
    assert {r.doc_id: r.grade for r in qc.grades_of(labels).collect()}[1] == 1
    model = qc.train(docs, qc.grades_of(labels))
    out = qc.score(docs, model).collect()
    assert len(out) == 64 and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    by = {r.doc_id: r.kept for r in out}
    assert by[5] and not by[6]
    nothing = qc.train(docs, qc.grades_of(labels.limit(0)))
    assert not nothing.weights.any() and qc.score(docs.limit(0), nothing).count() == 0
