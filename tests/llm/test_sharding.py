import contextlib
import io
import random
import zlib
from hashlib import md5

import pytest

from hustings.llm import sharding as sh

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, size string, shard string, digest int, end int"


def by_hand(texts, shards):
    """Capacity by dynamic programming, and the shard of every digest."""
    sizes = {}
    for t in texts:
        d = md5((t or "").encode()).hexdigest()
        sizes[d] = sizes.get(d, 0) + len((t or "").encode()) + 1
    order = sorted(sizes)
    ends = [0]
    for d in order:
        ends.append(ends[-1] + sizes[d])
    best = list(ends)
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1], sizes


def placed(spark, texts, shards=8):
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in sh.shard_documents(df, shards).collect()}


def check(spark, texts, shards=8):
    got = placed(spark, texts, shards)
    capacity, sizes = by_hand(texts, shards)
    assert sorted(got) == list(range(len(texts)))
    full, slots, homes = [0] * shards, {}, {}
    for i, t in enumerate(texts):
        r, raw = got[i], (t or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        full[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(md5(raw).hexdigest(), set()).add(r.shard)
    assert max(full) == capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    in_order = [next(iter(homes[d])) for d in sorted(homes)]
    assert in_order == sorted(in_order)
    return full


@pytest.mark.parametrize("seed", range(3))
def test_against_dynamic_programming(spark, seed, monkeypatch):
    monkeypatch.setattr(sh, "BINS", 16)  # several rounds on a small table
    rng = random.Random(seed)
    check(spark, ["é" * rng.choice([0, 1, 5, 40, 400]) + str(rng.randrange(60)) for _ in range(200)], rng.choice([3, 8]))


def test_a_text_that_a_third_share_stays_whole_and_the_rest_is_even(spark):
    rng = random.Random(1)
    texts = ["the same text over and over"] * 300 + [f"{rng.random()} {i} text" for i in range(600)]
    full = check(spark, texts)
    assert min(full) > 0


def test_odd_rows(spark):
    check(spark, [None, "", None, "a", "a", "b", "x" * 300_000])
    check(spark, ["same"] * 20)
    assert placed(spark, []) == {}
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r["size"]) for r in sh.shard_documents(df).collect()) == [(0, 2), (0, 2), (1, 1)]


def test_plan_is_native(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sh.op13_sharding(spark, SF).explain()
    assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow"))
