import numpy as np
import pyarrow as pa
import pytest

from hustings.operators import response, scale


def responses(spark, dims, n=120, m=30, missing=0.0, seed=11):
    rnd = np.random.default_rng(seed)
    theta, a = rnd.normal(size=(n, dims)), rnd.normal(size=(m, dims))
    b = rnd.normal(size=m) * 0.5
    y = theta @ a.T - b + rnd.normal(size=(n, m)) * 0.3
    rows = [
        (f"s{i:03d}", f"t{j:02d}", float(y[i, j])) for i in range(n) for j in range(m) if rnd.random() >= missing
    ]
    return theta, a, spark.createDataFrame(rows, "speaker string, topic string, stance_score double")


def falls(values):
    return all(later <= earlier + 1e-6 * abs(earlier) for earlier, later in zip(values, values[1:]))


@pytest.mark.parametrize("zeros, missing", [("observed", 0.0), ("missing", 0.4)])
def test_recovery(spark, zeros, missing):
    theta, a, cells = responses(spark, 1, missing=missing)
    model = scale.fit_irt(cells, 1, zeros=zeros)
    got = model.speakers.orderBy("speaker").toPandas()
    assert abs(np.corrcoef(got["t0"], theta[:, 0])[0, 1]) > 0.95
    assert falls(model.objective)
    topics = model.topics.orderBy("topic").toPandas()
    assert topics.loc[topics["a0"].abs().idxmax(), "a0"] > 0
    assert 0.05 < model.sigma2 < 0.2
    assert np.std(got["t0"]) == pytest.approx(1, abs=0.25)


def test_starts_agree(spark):
    _, _, cells = responses(spark, 1, n=60, m=12)
    a, b = (scale.fit_irt(cells, 1, seed=seed).speakers.orderBy("speaker").toPandas()["t0"] for seed in (1, 2))
    assert np.allclose(a, b, atol=1e-4)


def test_plane_up_to_rotation(spark):
    theta, _, cells = responses(spark, 2)
    model = scale.fit_irt(cells, 2)
    got = model.speakers.orderBy("speaker").toPandas()[["t0", "t1"]].values
    fit, *_ = np.linalg.lstsq(got, theta - theta.mean(0), rcond=None)
    left = (theta - theta.mean(0)) - got @ fit
    assert left.var() < 0.1 * theta.var()
    assert falls(model.objective)
    assert abs(np.corrcoef(got.T)[0, 1]) < 0.05


def test_zeros_are_counted_without_being_written(spark):
    """Dropping explicit zeros changes nothing when missing cells count as zeros."""
    _, _, cells = responses(spark, 1, n=40, m=10)
    holes = cells.selectExpr("speaker", "topic", "if(pmod(hash(speaker, topic), 3) = 0, 0.0, stance_score) AS stance_score")
    one = scale.fit_irt(holes, 1).speakers.orderBy("speaker").toPandas()["t0"]
    two = scale.fit_irt(holes, 1, zeros="missing").speakers.orderBy("speaker").toPandas()["t0"]
    assert np.allclose(one, two, atol=1e-6)


def test_components_match_numpy(spark):
    _, _, cells = responses(spark, 2, n=50, m=8)
    wide = cells.toPandas().pivot(index="speaker", columns="topic", values="stance_score").sort_index()
    model = scale.fit_pca(cells, 2)
    got = scale.wide_positions(scale.project_cells(cells, model), 2).orderBy("speaker").toPandas()[["dim1", "dim2"]].values
    u, s, vt = np.linalg.svd(wide.values - wide.values.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert np.allclose(model.explained, s[:2] ** 2 / (s**2).sum() * 100)
    assert abs(np.corrcoef(got.T)[0, 1]) < 1e-8
    raw = scale.fit_svd(cells, 2)
    got = scale.wide_positions(scale.project_cells(cells, raw, centered=False), 2).orderBy("speaker").toPandas()[["dim1", "dim2"]].values
    u, s, vt = np.linalg.svd(wide.values, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    share = (u[:, :2] * s[:2]).var(0) / wide.values.var(0).sum() * 100
    assert np.allclose(raw.explained, share)


def test_bad_arguments(spark):
    _, _, cells = responses(spark, 1, n=5, m=3)
    with pytest.raises(ValueError):
        scale.fit_irt(cells, 3)
    with pytest.raises(ValueError):
        scale.embedding_table(cells, cells, "umap")


def test_topic_names_with_signs(spark):
    _, _, cells = responses(spark, 1, n=20, m=4)
    odd = cells.replace({"t00": "Misc.", "t01": "U.S. Trade", "t02": "a `b`"}, subset=["topic"])
    plain = scale.fit_pca(cells, 1)
    assert np.allclose(sorted(scale.fit_pca(odd, 1).explained), sorted(plain.explained))


def filled(cells):
    wide = cells.toPandas().pivot(index="speaker", columns="topic", values="stance_score").fillna(0.0).sort_index().sort_index(axis=1)
    return wide.values


@pytest.mark.parametrize("centered", [True, False])
def test_block_iteration_agrees_with_cross_products(spark, centered):
    """More topics than the driver takes: the same components from a block of directions."""
    _, _, cells = responses(spark, 2, n=90, m=40, missing=0.5)
    fit = scale.fit_pca if centered else scale.fit_svd
    one, two = (fit(cells, 2, gram=bound) for bound in (1_000, 10))
    assert np.allclose(one.explained, two.explained, rtol=1e-8)
    assert np.allclose(one.shift, two.shift, atol=1e-6)
    assert one.rows == two.rows and one.total_variance == pytest.approx(two.total_variance)
    a, b = (m.loadings.orderBy("topic").toPandas()[["l1", "l2"]].values for m in (one, two))
    assert np.allclose(a, b, atol=1e-6)
    x = filled(cells)
    _, s, vt = np.linalg.svd(x - x.mean(0) if centered else x, full_matrices=False)
    assert np.allclose(np.abs(b), np.abs(vt[:2].T), atol=1e-6)


def test_components_of_small_matrices(spark):
    schema = "speaker string, topic string, stance_score double"
    one = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 3.0), ("c", "t", None)], schema)
    model = scale.fit_pca(one, 2)
    assert model.explained == pytest.approx([100.0]) and model.rows == 3
    got = {r.speaker: r.value for r in scale.project_cells(one.na.fill(0.0), model).collect()}
    assert got == pytest.approx({"a": 1 - 4 / 3, "b": 3 - 4 / 3, "c": -4 / 3})
    still = spark.createDataFrame([("a", "t", 0.0), ("b", "u", 0.0)], schema)
    assert scale.fit_pca(still, 2).explained == [0.0, 0.0]


@pytest.mark.parametrize("centered", [True, False])
def test_many_dimensions_make_no_row_of_a_cell_and_a_dimension(spark, centered):
    """Positions along more dimensions than stand side by side; topics the model lacks do not count."""
    _, _, cells = responses(spark, 2, n=40, m=24, missing=0.3)
    model = (scale.fit_pca if centered else scale.fit_svd)(cells, 24)
    odd = [("s000", "unseen", 1.0), ("all null", "t01", None), ("unseen only", "unseen", 1.0), (None, "t02", 2.0), (None, "t03", None)]
    lower = cells.selectExpr("speaker", "topic", "stance_score - 1")  # of a cell given twice the larger score counts
    long = scale.project_cells(cells.union(lower).union(spark.createDataFrame(odd, cells.schema)), model, centered)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "loading" not in plan and "Generate" not in plan
    got = {}
    for r in long.collect():
        got.setdefault(r.speaker, {})[r.dim] = r.value
    assert long.dtypes == [("speaker", "string"), ("dim", "int"), ("value", "double")]
    assert all(sorted(v) == list(range(1, 25)) for v in got.values())
    assert set(got.pop("all null").values()) == {None} and "unseen only" not in got
    shift = np.array(model.shift) if centered else 0.0
    loadings = model.loadings.orderBy("topic").toPandas().iloc[:, 1:].values
    assert np.allclose([got[None][i] for i in range(1, 25)], 2.0 * loadings[2] - shift)
    want = filled(cells) @ loadings - shift
    assert np.allclose([[got[f"s{s:03d}"][i] for i in range(1, 25)] for s in range(40)], want)


@pytest.mark.parametrize("dims", [1, 2])
def test_closed_form_equals_the_iterated_fit(spark, dims):
    _, _, cells = responses(spark, dims, n=40, m=10)
    holes = cells.selectExpr("speaker", "topic", "if(pmod(hash(speaker, topic), 3) = 0, 0.0, stance_score) AS stance_score")
    one, two = scale.fit_irt(holes.where("stance_score <> 0"), dims), scale.fit_irt(holes, dims, zeros="missing")
    assert one.rounds == 0 < two.rounds
    assert one.sigma2 == pytest.approx(two.sigma2, rel=1e-6)
    for a, b, key in ((one.speakers, two.speakers, "speaker"), (one.topics.select("topic", "a0", "b"), two.topics.select("topic", "a0", "b"), "topic")):
        assert np.allclose(*(t.orderBy(key).toPandas().iloc[:, 1:].values for t in (a, b)), atol=1e-6)


def test_closed_form_with_more_topics_than_the_driver_takes(spark):
    _, _, cells = responses(spark, 1, n=60, m=30, missing=0.3)
    one, two = (scale.fit_irt(cells, 1, gram=bound) for bound in (100, 10))
    assert one.sigma2 == pytest.approx(two.sigma2, rel=1e-6)
    assert np.allclose(*(m.speakers.orderBy("speaker").toPandas()["t0"] for m in (one, two)), atol=1e-5)


def test_joined_rounds_agree_with_sent_out_parameters(spark):
    _, _, cells = responses(spark, 1, n=50, m=12, missing=0.3)
    one, two = (scale.fit_irt(cells, 1, zeros="missing", topics=bound) for bound in (100, 5))
    assert one.sigma2 == pytest.approx(two.sigma2, rel=1e-4)
    assert np.allclose(*(m.speakers.orderBy("speaker").toPandas()["t0"] for m in (one, two)), atol=1e-3)
    assert falls(two.objective)


def test_a_fit_that_does_not_settle_is_an_error(spark):
    _, _, cells = responses(spark, 1, n=20, m=6, missing=0.3)
    for bound in (100, 3):
        with pytest.raises(RuntimeError, match="settle"):
            scale.fit_irt(cells, 1, zeros="missing", topics=bound, rounds=4)
    with pytest.raises(ValueError, match="no cells"):
        scale.fit_irt(cells.limit(0), 1, zeros="missing")


def test_slope_is_that_of_the_objective(spark):
    """The step's slope against differences of the objective, theta integrated out."""
    from hustings.operators import response

    _, _, cells = responses(spark, 2, n=15, m=4, missing=0.2)
    work = response._Rounds(cells.withColumnRenamed("stance_score", "y"), 2)
    work.squares = cells.selectExpr("sum(stance_score * stance_score)").first()[0]
    x = np.random.default_rng(1).normal(size=13) * 0.5
    point = response._Point(work, x)
    for i in (0, 4, 5, 12):
        up, down = (response._Point(work, x + h * np.eye(13)[i]).value for h in (1e-5, -1e-5))
        assert (up - down) / 2e-5 == pytest.approx(point.slope[i], rel=1e-5, abs=1e-5)


def test_cells_are_handed_to_rounds_as_bytes_and_in_short_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", f"t{j:02d}", float(rng.normal())) for i in range(30) for j in range(12) if rng.random() < 0.6 or j == i % 12]
    obs = spark.createDataFrame(rows, "speaker string, topic string, y double")
    work = response._Rounds(obs, 2)
    assert dict(work.rows.dtypes) == {"speaker": "string", "places": "binary", "scores": "binary"}
    params, sigma2 = rng.normal(size=(12, 3)), 0.7
    got, cost = work.sums(params, sigma2)
    second, right, plain = np.zeros((12, 3, 3)), np.zeros((12, 3)), 0.0
    means = {}
    for s in {r[0] for r in rows}:
        at, y = zip(*[(int(t[1:]), v) for who, t, v in rows if who == s])
        at, y = np.array(at), np.array(y)
        a, shifted = params[at, :2], y + params[at, 2]
        spread = np.linalg.inv(a.T @ a / sigma2 + np.eye(2))
        means[s] = mean = spread @ (a.T @ shifted) / sigma2
        x = np.append(mean, -1.0)
        moments = np.outer(x, x)
        moments[:2, :2] += spread
        second[at] += moments
        right[at] += x * y[:, None]
        plain += shifted @ shifted / sigma2 - (a.T @ shifted / sigma2) @ mean - np.linalg.slogdet(spread)[1]
    assert np.allclose(got, np.column_stack([second.reshape(12, 9), right])) and np.isclose(cost, plain)
    placed = {r.speaker: (r.t0, r.t1) for r in work.speakers(params, sigma2).collect()}
    assert placed.keys() == means.keys() and all(np.allclose(placed[s], means[s]) for s in means)

    ends = np.array([0, 5, 5, 40, 41, 43])
    assert list(response._cuts(ends, 4)) == [(0, 1), (1, 2), (2, 3), (3, 5)]
    lists = pa.array([[{"place": 1, "y": 0.5}, {"place": 0, "y": 2.0}], [{"place": 2, "y": 1.0}]])
    monkeypatch.setattr(response, "BATCH", 2)
    out = list(response._packed(iter([pa.record_batch([pa.array(["a", "b"]), lists], ["speaker", "c"])])))
    assert [b.num_rows for b in out] == [1, 1]
    assert [response._unpacked(b.column("scores"), np.float64)[0].tolist() for b in out] == [[0.5, 2.0], [1.0]]
    whole = pa.array([b"", np.arange(3, dtype=np.int32).tobytes(), np.array([7], np.int32).tobytes()], pa.large_binary())
    assert [x.tolist() for x in response._unpacked(whole.slice(1), np.int32)] == [[0, 1, 2, 7], [0, 3, 4]]
