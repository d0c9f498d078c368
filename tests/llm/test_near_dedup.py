import random

import numpy as np
from pyspark.sql import functions as F

from hustings.llm import near_dedup as nd
from hustings.llm.shared import WordHashes

SF = "/root/testdata/sf0.001"


def word_sets(rows, width):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute(rows, width, percent):
    sets = word_sets(rows, width)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(nd.op2_near_dedup(spark, SF)) == brute(rows, 2, 80)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text at every distance, so that many lie just inside and just outside of a link."""
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 60)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{rnd.randint(0, 3000)}" for _ in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 2, 80)
    assert len({c for _, c, _ in want.values()}) > 50
    assert found(nd.near_duplicate_components(df, 2, 80)) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (7, "One"), (6, "oNE "), (8, "two words"), (9, "TWO  words"), (2, long), (11, long + " end"), (12, "É"), (13, "é")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, n int")
    got = found(nd.near_duplicate_components(df, 5, 80))
    assert got == brute(rows, 5, 80)
    assert got[5] == (0, 5, True) and got[6] == (1, 6, True) and got[7] == (1, 6, False)
    again = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "alone")], "doc_id long, text string")
    out = sorted(map(tuple, nd.near_duplicate_components(again).collect()), key=str)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True)], key=str)
    assert nd.near_duplicate_components(df.limit(0)).count() == 0
    assert nd.keep_one_per_group(df).columns == df.columns


def test_registers_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        common = round(2 * 3000 * share / (1 + share))
        b = np.concatenate([a[:common], rnd.integers(0, 1 << 63, 3000 - common, dtype=np.uint64)])
        one, two, both = nd.registers([a, b, np.unique(np.concatenate([a, b]))])
        assert (np.maximum(one, two) == both).all()
        size = np.array([3000.0])
        assert abs(nd.similarity(one[None], two[None], size, size)[0] - share) < 0.12


def test_shingles():
    h = WordHashes()
    assert len(nd.shingle_set("a b a b a", 2, h)) == 2 and len(nd.shingle_set("a", 2, h)) == 1
    assert (nd.shingle_set("A\tb", 2, h) == nd.shingle_set("a b", 2, h)).all()
    assert not len(nd.shingle_set(None, 2, h)) and not len(nd.shingle_set(" \n", 2, h))
