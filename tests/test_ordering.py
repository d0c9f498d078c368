import numpy as np
import pandas as pd

from hustings.operators import groups, ordering


def skewed(spark, n=2000):
    rnd = np.random.default_rng(3)
    x = np.where(rnd.random(n) < 0.4, 1.5, rnd.integers(-200, 200, n) / 4)
    return pd.DataFrame({"id": np.arange(n), "g": rnd.choice(["a", "a", "a", "b"], n), "x": x})


def test_average_rank_and_positions(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf)
    got = ordering.average_rank(df, "x", "r", ["g"]).toPandas().sort_values("id")
    want = pdf.groupby("g")["x"].rank()
    assert np.allclose(got["r"].values, want.values)
    place = ordering.positions(df, ["x", "id"]).toPandas()
    assert list(place.sort_values("position")["id"]) == list(pdf.sort_values(["x", "id"])["id"])


def test_quantiles(spark):
    pdf = skewed(spark)
    qs = {"q1": 0.1, "median": 0.5, "q9": 0.93}
    got = ordering.exact_quantiles(spark.createDataFrame(pdf), "x", qs, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, q in qs.items():
            assert np.isclose(got.loc[g, name], part["x"].quantile(q))


def test_codes_are_sorted(spark):
    df = spark.createDataFrame([(s,) for s in ["é", "b", "a", "b", "Z"]], "k string")
    got = {r.k: r.code for r in ordering.index_keys(df, "k", "code").collect()}
    assert got == {k: i for i, k in enumerate(sorted({"é", "b", "a", "Z"}))}


def test_first_by_takes_the_first(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    got = {r.k: r.v for r in ordering.first_by(df, ["k"], ["o"]).collect()}
    assert got == {"a": None, "b": "z"}


def test_top_per_group_is_cut_before_the_shuffle(spark, capsys):
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    ordering.top_per_group(df, ["g"], [F.desc("id")], 5).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_stratified_split(spark):
    rows = [(i, i % 3 if i % 5 else 0) for i in range(997)]
    got = groups.stratified_split(spark.createDataFrame(rows, "id int, label int"), "label", "id").toPandas()
    assert sorted(got["id"]) == list(range(997))
    for label, part in got.groupby("label"):
        n = len(part)
        sizes = part["split"].value_counts()
        assert sizes["train"] == int(n * 0.8) and sizes["val"] == int(n * 0.1)


def test_group_targets_pads_with_the_first(spark):
    df = spark.createDataFrame([("p", 1, "x"), ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("q", 4, "d")], "post string, o int, t string")
    got = {r.post: (r.t, r.valid) for r in groups.group_targets(df, "post", "o", ["t"]).collect()}
    assert got == {"p": (["x", "x", "x"], [1, 0, 0]), "q": (["a", "b", "c"], [1, 1, 1])}


def test_sample_takes_all_when_there_are_few(spark):
    assert groups.sample_n(spark.range(7), "id", 100).count() == 7
    one = groups.sample_n(spark.range(500), "id", 20).toPandas()
    assert list(one["id"]) == list(groups.sample_n(spark.range(500).repartition(5), "id", 20).toPandas()["id"])
