import hashlib
import random
from math import floor, isfinite

import numpy as np
import pytest

from hustings.llm import centroid_clusters as cc

SCHEMA = "vec_id long, embedding array<float>, cluster string, planes int, seed int, distance string"


def by_hand(rows, centroids=16, rounds=3):
    kept = [(i, [floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and isfinite(x) for x in e)]
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    at = [v for _, v in sorted(named)[:centroids]]

    def assigned():
        out = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
            out.append((i, v, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        now = assigned()
        for k in range(len(at)):
            mine = [v for _, v, c, _ in now if c == k]
            if mine:
                at[k] = [sum(col) // len(mine) for col in zip(*mine)]
    now, most = assigned(), 2**63 - 1
    inertia = {}
    for _, _, k, d in now:
        inertia[k] = inertia.get(k, 0) + min(d, most)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(
        (i if i is not None else -1, k, min(d, most), min(inertia[k], most), min(sum(inertia.values()), most), digests[k]) for i, _, k, d in now
    )


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "x", 1, 2, "y") for i, e in rows], SCHEMA)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in cc.centroid_clusters(df, **kw).collect())


def vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    return [(i * 7 % 1009, [float(x) for x in np.float32(rng.normal(0, size, 64))]) for i in range(n)]


@pytest.mark.parametrize("size", [0.01, 1.0, 3e4, 3e30])
def test_against_whole_numbers(spark, size):
    rows = vectors(120, size, 3)
    assert run(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    good = vectors(40, 0.2, 5)
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [float("nan")] + [0.0] * 63), (906, [float("-inf")] * 64)]
    odd = [good[0], good[0], (good[1][0], good[2][1]), (None, good[3][1]), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [1e30] + [0.0] * 63)]
    rows = good + bad + odd
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, good[:5]) == by_hand(good[:5])
    assert run(spark, [(7, [0.5] * 64)] * 30) == by_hand([(7, [0.5] * 64)] * 30)
    assert run(spark, bad) == []
    assert run(spark, []) == []


def test_dots_of_planes():
    rng = np.random.default_rng(2)
    for width in (1, 7, 20, 33, 60):
        a, b = (rng.integers(-(2**width), 2**width, (9, 64)) for _ in range(2))
        n, m = int(cc.n_planes(a).max()), int(cc.n_planes(b).max())
        want = a.astype(object) @ b.astype(object).T
        assert (cc.dots(cc.to_planes(a, n), cc.to_planes(b, m)) == want).all()
        assert (cc.from_planes(cc.to_planes(a, n)) == a).all()
