"""Against a plain hierarchy over the same grid: union-find by level, clusters by recursion."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from hustings.operators import density

WIDTH, POINTS, SIZE, REACH = 0.25, 4, 12, 3


def plain(points):
    """Label of each point of one parent, and the validity sums of the clusters."""
    cells = Counter(tuple(math.floor(x / WIDTH) for x in p) for p in points)
    places = sorted(cells)
    gap = {(a, b): sum((x - y) ** 2 for x, y in zip(a, b)) for a in places for b in places}
    levels = density._levels(len(places[0]), REACH)
    core = {}
    for a in places:
        core[a] = next((v for v in levels if sum(cells[b] for b in places if gap[a, b] <= v) >= POINTS), None)
    alive = [a for a in places if core[a] is not None]
    far = {(a, b): max(core[a], core[b], gap[a, b]) for a in alive for b in alive if a < b}

    def comps(members, v):
        left, out = {a for a in members if core[a] <= v}, []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                a = todo.pop()
                seen.add(a)
                near = {b for b in left if far[min(a, b), max(a, b)] <= v}
                left -= near
                todo += near
            out.append(frozenset(seen))
        return [c for c in out if sum(cells[a] for a in c) >= SIZE]

    dense = [1 / (WIDTH * math.sqrt(max(v, 0.25))) for v in levels]

    def solve(members, i):
        """Chosen clusters at or below one whose part on level i is ``members``, and their worth."""
        stability, at = 0.0, members
        while True:
            stability += sum(cells[a] for a in at) * (dense[i] - dense[min(i + 1, len(levels) - 1)])
            parts = comps(at, levels[i - 1]) if i else []
            i -= 1
            if len(parts) != 1:
                break
            at = parts[0]
        below = [solve(p, i) for p in parts]
        if below and sum(w for _, w in below) > stability:
            return [c for found, _ in below for c in found], sum(w for _, w in below)
        return [members], stability

    chosen = [c for top in comps(alive, levels[-1]) for c in solve(top, len(levels) - 1)[0]]
    chosen.sort(key=min)
    label = {a: k for k, c in enumerate(chosen) for a in c}
    worth = 0.0
    for c in chosen:
        sparse = next(v for v in levels if len(comps(c, v)) == 1 and comps(c, v)[0] == c)
        apart = min((far[min(a, b), max(a, b)] for a in c for d in chosen if d is not c for b in d), default=math.inf)
        sparse, apart = WIDTH * math.sqrt(max(sparse, 0.25)), WIDTH * math.sqrt(apart) if apart <= REACH**2 else WIDTH * REACH
        worth += (apart - sparse) / max(apart, sparse) * sum(cells[a] for a in c)
    return [label.get(tuple(math.floor(x / WIDTH) for x in p), -1) for p in points], len(chosen), worth


def sample(seed, n):
    rnd = np.random.default_rng(seed)
    centers = rnd.uniform(-3, 3, (5, 2))
    rows = [c + rnd.normal(size=2) * s for c, s in zip(centers, (0.1, 0.2, 0.3, 0.45, 0.6)) for _ in range(n // 7)]
    return [tuple(map(float, p)) for p in [*rows, *rnd.uniform(-4, 4, (n - len(rows), 2))]]


@pytest.fixture(scope="module")
def frame(spark):
    parents = {"a": sample(1, 500), "b": sample(2, 400), "c": sample(3, 12)}
    rows = [(p, i, *xy, "x") for p, points in parents.items() for i, xy in enumerate(points)]
    return parents, spark.createDataFrame(rows, "parent string, id int, x double, y double, n string")


def test_clusters_of_each_parent(spark, frame):
    parents, df = frame
    got = {(r.parent, r.id): r.label for r in density.hierarchical_clusters(df, ["parent"], ["x", "y"], WIDTH, POINTS, SIZE, REACH).collect()}
    assert len(got) == 912
    for parent, points in parents.items():
        want, count, _ = plain(points)
        assert [got[parent, i] for i in range(len(points))] == want
        assert parent == "c" or (count > 2 and -1 in want)


def test_validity(spark, frame):
    parents, df = frame
    got = {r.parent: r for r in density.density_validity(df, ["parent"], ["x", "y"], WIDTH, POINTS, SIZE, REACH).collect()}
    for parent, points in parents.items():
        labels, count, worth = plain(points)
        r, inside = got[parent], sum(k >= 0 for k in labels)
        assert (r.points, r.clustered, r.clusters) == (len(points), inside, count)
        assert r.validity == pytest.approx(worth / len(points))
        assert (r.validity_clustered is None) if not inside else r.validity_clustered == pytest.approx(worth / inside)


def test_query_against_the_plain_hierarchy(spark, monkeypatch):
    from hustings.catalog import taxonomies

    sf = "/root/testdata/sf0.001"
    for name, value in zip(("WIDTH", "POINTS", "SIZE", "REACH"), taxonomies.DENSITY):
        monkeypatch.setitem(globals(), name, value)
    points = defaultdict(dict)
    for r in taxonomies.projected_vectors(spark, sf).collect():
        points[r.parent][r.vec_id] = (r.x0, r.x1)
    got = {r.vec_id: r.label for r in taxonomies.density_hierarchy(spark, sf).collect()}
    for here in points.values():
        assert plain(list(here.values()))[0] == [got[v] for v in here]


def test_odd_points(spark):
    rows = [("p", 1.0, 1.0)] * 40 + [("p", None, 1.0), ("p", 9.0, 9.0)]
    out = density.hierarchical_clusters(spark.createDataFrame(rows, "parent string, x double, y double"), ["parent"], ["x", "y"], WIDTH, POINTS, SIZE)
    assert Counter(r.label for r in out.collect()) == {0: 40, -1: 2}
    with pytest.raises(ValueError, match="too many"):
        density.hierarchical_clusters(out.selectExpr("parent", *[f"x AS x{i}" for i in range(6)]), ["parent"], [f"x{i}" for i in range(6)], 1.0, 2, 2)
