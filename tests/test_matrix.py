import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import filters, groups, matrix, pool, resolve

CELLS = "speaker string, subtopic_1 string, subtopic_2 string, stance_score double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_own_cells_stay_under_another_parent(spark):
    cells = spark.createDataFrame([("A", "P1", "s", 0.5), ("A", "P1", "t", 0.1), ("B", "P2", "s", -0.5), ("B", "P1", "s", 0.2)], CELLS)
    children = spark.createDataFrame([("s", "P2"), ("t", "P1"), ("u", "P2")], "subtopic_2 string, subtopic_1 string")
    got = matrix.fill_from_parent(cells, pool.topic_scores(cells), children)
    assert rows(got) == [
        ("A", "P1", "t", 0.1, True), ("A", "P2", "s", 0.5, True), ("B", "P1", "t", 0.2, False),
        ("B", "P2", "s", 0.2, True), ("B", "P2", "u", -0.5, False),
    ]


def test_filled_matrix_is_made_where_its_speakers_lie(spark):
    """Own scores and parents' scores are shuffled, by speaker; the cells made of them are not."""
    rnd = random.Random(5)
    cells = spark.createDataFrame([(f"S{rnd.randrange(9)}", f"P{i % 4}", f"t{i % 40}", rnd.random()) for i in range(300)], CELLS)
    got = matrix.fill_from_parent(cells, pool.topic_scores(cells), resolve.topic_parents(cells))
    marked = matrix._marked(got.withColumn("topic", F.col("subtopic_2")), "topic")
    plan = marked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    by = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    assert "FullOuter" not in plan and by.count({"speaker"}) == 2
    assert all(x in ({"speaker"}, {"speaker", "subtopic_1"}) for x in by)


def test_filled_cells_of_no_speaker_and_of_repeated_keys(spark):
    """Null keys meet nothing, repeated parents and children each give a cell."""
    cells = spark.createDataFrame([(None, "P", "s", 0.5), ("A", "P", "s", 0.1), ("A", "Q", None, 0.2), ("B", None, "u", None)], CELLS)
    parents = spark.createDataFrame([(None, "P", 0.7), ("A", "P", 0.3), ("A", "P", 0.4), ("B", None, 0.9)], "speaker string, subtopic_1 string, stance_score double")
    children = spark.createDataFrame([("s", "P"), (None, "P"), ("u", "Q")], "subtopic_2 string, subtopic_1 string")
    got = [tuple(r) for r in matrix.fill_from_parent(cells, parents, children).collect()]
    assert sorted(got, key=str) == sorted([
        (None, "P", "s", 0.5, True), (None, "P", "s", 0.7, False), (None, "P", None, 0.7, False),
        ("A", "P", "s", 0.1, True), ("A", "P", "s", 0.1, True), ("A", "Q", None, 0.2, True),
        ("A", "P", None, 0.3, False), ("A", "P", None, 0.4, False), ("B", "Q", "u", None, False),
    ], key=str)


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_coverage_filter_against_brute_force(spark, share):
    """Repeated cells, zeros and nulls; cells are kept by what was written beside them, not by a join."""
    rnd = random.Random(8)
    cells = [(rnd.choice([None, *"ABCDEFGHIJ"[: rnd.randrange(2, 11)]]), rnd.choice([None, *(f"t{i}" for i in range(rnd.randrange(1, 14)))]), rnd.choice([None, 0.0, 0.5, -1.0])) for _ in range(160)]
    df = spark.createDataFrame(cells, "speaker string, topic string, stance_score double")
    got = matrix.coverage_filter(df, 0.6, 0.5, share)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and set(got.columns) == set(df.columns)

    def partners(rows, by, of):
        return {k: len({r[of] for r in rows if r[by] == k and r[2] and r[of] is not None}) for k in {r[by] for r in rows}}

    n = partners(cells, 0, 1)
    kept = [r for r in cells if r[0] is not None and n[r[0]] >= np.quantile([*n.values()], 0.6)]
    m = {t: 0 for t in {r[1] for r in cells}} | {t: x for t, x in partners(kept, 1, 0).items() if t is not None}
    good = {t for t, x in m.items() if t is not None and x >= np.quantile([*m.values()], 0.5) and x / len({r[0] for r in kept}) >= share}
    want = [r for r in kept if r[1] in good]
    assert want and sorted(map(tuple, got.select(*df.columns).collect()), key=str) == sorted(want, key=str)


def test_last_pair_names_the_parent(spark):
    df = spark.createDataFrame([(0, "s", "Z"), (1, "s", "A"), (2, "s", "Z"), (3, "t", "B")], "o int, subtopic_2 string, subtopic_1 string")
    assert rows(resolve.topic_parents(df, "o")) == [("s", "A"), ("t", "B")]


def test_topics_of_nobody_kept_count_as_zero(spark):
    cells = [("A", t, 1.0) for t in "abcd"] + [("B", t, 1.0) for t in "abc"] + [("C", t, 1.0) for t in "efgh"[:1]] + [("D", "f", 1.0)]
    df = spark.createDataFrame(cells, "speaker string, topic string, stance_score double")
    got = matrix.coverage_filter(df, 0.5, 0.5)
    # Counts over A and B are 2 2 2 1 0 0: their median is 1.5, without the zeros it would be 2.
    assert {r.topic for r in got.collect()} == {"a", "b", "c"}
    got = matrix.coverage_filter(df, 0.5, 0.4)
    assert {r.topic for r in got.collect()} == {"a", "b", "c", "d"}


def test_topic_names_with_signs(spark):
    names = ["Misc.", "U.S. Trade", "a `b`"]
    df = spark.createDataFrame([("A", n, float(i)) for i, n in enumerate(names)] + [("B", "Misc.", 7.0)], "speaker string, topic string, stance_score double")
    wide = matrix.to_matrix(df, names)
    assert wide.columns == ["speaker", *names]
    assert rows(matrix.to_long(wide, ["speaker"], names)) == rows(df)
    filled = matrix.filled_matrix(df.withColumnRenamed("topic", "subtopic_2"), names)
    assert rows(filled) == [("A", 0.0, 1.0, 2.0), ("B", 7.0, 0.0, 0.0)]


def test_first_of_several_values_of_a_cell(spark):
    df = spark.createDataFrame([("A", "t", 0.9, 2), ("A", "t", 0.1, 1)], "speaker string, topic string, stance_score double, o int")
    assert matrix.to_matrix(df, ["t"], order="o").first()["t"] == 0.1 and matrix.one_per_cell(df, "o").first()["stance_score"] == 0.1
    assert matrix.to_matrix(df, ["t"]).first()["t"] == matrix.one_per_cell(df).first()["stance_score"] == 0.9


def test_nothing_to_divide_by(spark):
    zero = spark.createDataFrame([("g", 0.5, 0.2, 0), ("h", 0.5, 0.1, 1)], "k string, prob_against double, prob_favor double, w int")
    zero = zero.withColumnsRenamed({"prob_against": pool.PROBS[0], "prob_favor": pool.PROBS[1]})
    got = {r.k: r.confidence for r in pool.weighted_confidence(zero, ["k"], "w").collect()}
    assert got["g"] is None and got["h"] == pytest.approx(2 / 3, abs=1e-3)
    one = spark.createDataFrame([("A", "t", 1.0)], "speaker string, topic string, stance_score double")
    assert matrix.coverage_summary(one, "speaker", "topic").first()["std_coverage"] is None
    assert filters.drop_report(one.limit(0), one.speaker == "A").first()["pct_dropped"] is None
    nothing = spark.createDataFrame([("a", "b", 0)], "p string, c string, n int")
    assert groups.share(nothing, "n", ["p"]).first()["pct_of_total"] is None
    assert matrix.coverage_report(one.limit(0), "speaker", "topic").count() == 0


def test_topic_covariance_does_not_go_through_the_driver(spark, monkeypatch):
    from hustings.catalog import positions

    def refused(*_, **__):
        raise AssertionError("rows made on the driver")

    want = {tuple(r) for r in positions.topic_covariance(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    monkeypatch.setattr(positions.matrix, "topic_list", refused)
    assert want and {tuple(r) for r in positions.topic_covariance(spark, "/root/testdata/sf0.001").collect()} == want
