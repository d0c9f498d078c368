import numpy as np
from pyspark.sql import functions as F

from hustings.operators import cluster, score, taxonomy


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101)]
    ids = list(range(61)) + [100, 101, 103, 200]
    v = spark.createDataFrame([(i,) for i in ids], "id int")
    got = {r.id: r.component for r in cluster.connected_components(v, spark.createDataFrame(chain, "src int, dst int")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200}


def test_components_of_a_long_bend(spark):
    """Two arms that meet at their far ends, with ids that alternate between them."""
    n = 100
    left, right = list(range(0, 2 * n, 2)), list(range(1, 2 * n, 2))
    path = left + right[::-1]
    edges = spark.createDataFrame(list(zip(path, path[1:])), "src int, dst int")
    got = cluster.connected_components(spark.range(2 * n + 1), edges).collect()
    assert {r.id: r.component for r in got} == {**{i: 0 for i in range(2 * n)}, 2 * n: 2 * n}


def test_density(spark):
    rnd = np.random.default_rng(2)
    rows = [("p", *map(float, c + rnd.normal(size=2) * 0.2)) for c in ([0, 0], [6, 6]) for _ in range(60)]
    rows += [("p", float(i), -20.0 * i) for i in range(1, 5)] + [("q", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "parent string, x double, y double").withColumn("id", F.monotonically_increasing_id())
    out = cluster.density_cluster(df, ["parent"], ["x", "y"], 0.5, 2, 10).toPandas()
    assert len(out) == len(rows)
    sizes = out[out.label != -1].groupby(["parent", "label"]).size()
    assert list(sizes.index) == [("p", 0), ("p", 1)] and sizes.min() >= 50
    quality = cluster.cluster_quality(spark.createDataFrame(out), ["parent"], ["x", "y"], "id").toPandas().set_index("parent")
    assert quality.loc["p", "quality"] > 0.9


def test_user_encoder_runs_once_per_text(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in cluster.embed_texts(df, "text", lambda: lambda ts: np.array([[len(t), 0.0] for t in ts])).collect()}
    assert got[1] == got[2] == got[3] == [1.0, 0.0] and got[4] is None


def test_majority_takes_first_seen_on_ties(spark):
    rows = [(0, "v", 2), (1, "v", 1), (2, "v", 1), (3, "v", 2), (4, "w", -1), (5, "w", -1), (6, "w", 3), (7, "m", 1)]
    out = taxonomy.enforce_majority(spark.createDataFrame(rows, "o int, k string, label int"), "k", "label", "o", misc="m")
    assert {r.o: r.label for r in out.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: -1, 5: -1, 6: -1, 7: -1}


def test_huge_nodes_spread_over_cells(spark):
    links = spark.range(1000).select(F.lit("n").alias("node"), F.col("id").alias("doc_id"))
    cells = taxonomy.join_ids(links, ["node"], "doc_id", cell=100)
    assert cells.count() == 10
    assert sorted(r.doc_id for r in taxonomy.explode_ids(cells, "ids").collect()) == list(range(1000))
    assert taxonomy.join_ids(links, ["node"], "doc_id").count() == 1


def test_labels_are_retried(spark):
    def flaky():
        calls = {"n": 0}

        def label(texts):
            calls["n"] += 1
            if calls["n"] % 3:
                raise RuntimeError("busy")
            return [t.upper() for t in texts]

        return label

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    got = {r.id: r.label for r in score.generate_labels(df, "text", flaky).collect()}
    assert got == {1: "A", 2: "Misc."}

    def dead():
        def label(texts):
            raise RuntimeError("down")

        return label

    assert {r.label for r in score.generate_labels(df, "text", dead).collect()} == {"Misc."}


def sequential(points):
    """One nearest pair at a time: members and height of every merge."""
    groups = {k: [k] for k in points}
    out = []
    while len(groups) > 1:
        far, a, b = min(
            (float(np.mean([((points[x] - points[y]) ** 2).sum() for x in groups[a] for y in groups[b]])), a, b)
            for a in groups for b in groups if a < b
        )
        groups[a] += groups.pop(b)
        out.append((frozenset(groups[a]), far))
    return out


def test_average_linkage_is_that_of_single_merges(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    points = {f"t{i:02d}": rnd.normal(size=5) for i in range(14)}
    df = spark.createDataFrame([(k, [float(x) for x in v], "x") for k, v in points.items()], "topic string, v array<double>, n string")
    want = sequential(points)
    for block in (8_000_000, 50):
        monkeypatch.setattr(cluster, "BLOCK", block)
        merges = sorted(cluster.average_linkage(df, "topic", "v").collect(), key=lambda r: r.distance)
        groups, got = {k: {k} for k in points}, []
        for r in merges:
            groups[r.left] |= groups.pop(r.right)
            got.append((frozenset(groups[r.left]), r.distance))
            assert r.size == len(groups[r.left])
        assert [g for g, _ in got] == [g for g, _ in want]
        assert np.allclose([d for _, d in got], [d for _, d in want])
    cut = cluster.topic_hierarchy(df, "topic", "v", 4).collect()
    groups = {k: {k} for k in points}
    for members, _ in want[:-3]:
        whole = set(members)
        groups = {k: v for k, v in groups.items() if not v <= whole} | {min(whole): whole}
    assert {frozenset(r.topic for r in cut if r.parent == p) for p in range(4)} == {frozenset(v) for v in groups.values()}


def test_linkage_of_equal_and_few_topics(spark):
    schema = "topic int, v array<double>"
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)] + [(8, None)], schema)
    merges = cluster.average_linkage(same, "topic", "v").collect()
    assert len(merges) == 6 and {r.distance for r in merges} == {0.0} and max(r["size"] for r in merges) == 7
    assert cluster.average_linkage(same.limit(1), "topic", "v").collect() == []
    assert [tuple(r) for r in cluster.topic_hierarchy(same.limit(1), "topic", "v", 3).collect()] == [(0, 0, 0)]
