import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hustings.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"


def brute(rows, share=0.0, backoff=lm.BACKOFF):
    texts = [(d, (t or "").lower().encode().split()) for d, t in rows]
    docs_of, counts = Counter(), Counter()
    for _, w in texts:
        docs_of.update(set(w))
    least = max(2.0, share * len(rows))
    runs = [(d, ["<s>", *(x if docs_of[x] >= least else "<unk>" for x in w), "</s>"]) for d, w in texts]
    pairs = Counter()
    for _, r in runs:
        counts.update(r)
        pairs.update(zip(r, r[1:]))
    tokens = sum(len(r) - 1 for _, r in runs)
    out = {}
    for d, r in runs:
        own = Counter(zip(r, r[1:]))
        total, seen = 0.0, 0
        for (a, b), n in own.items():
            others = pairs[a, b] - n
            total += n * (math.log(others / counts[a]) if others else math.log(backoff * counts[b] / tokens))
            seen += n if others else 0
        k, s, t = out.get(d, (0, 0, 0.0))
        out[d] = (k + len(r) - 1, s + seen, t + total)
    return out


def agree(got, want):
    assert {r.doc_id for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        n, seen, total = want[r.doc_id]
        assert (r.n_tokens, r.n_seen) == (n, seen)
        assert r.log_score == pytest.approx(total, abs=1e-6 * n) and r.mean_log_score == pytest.approx(total / n, abs=1e-5)


def test_query_against_counters(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    agree(lm.op4_lm_score(spark, SF).collect(), brute(rows))


def test_odd_rows_in_many_blocks(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a b a b c"), (3, "a b"), (None, "b c d"), (None, "b c"), (4, "a " * 30_000), (5, "only here"), (6, "d c b a é É")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    agree(lm.score(df.repartition(5), share=0.1).collect(), brute(rows, 0.1))
    assert lm.score(df.limit(0)).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, lm.score(df.coalesce(1)).collect()))
    assert sorted(map(tuple, lm.score(df.repartition(7, F.rand(1))).collect())) == one


def test_words_in_two_documents_are_known_at_every_size(spark):
    """Two words that two of 16,000 documents have each: not taken for one another."""
    rows = [(i, "x y") for i in range(16_000)] + [(20_000, "x rare"), (20_001, "x rare"), (20_002, "y pair"), (20_003, "y pair")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lm.score(df).where("doc_id >= 20000").collect()}
    want = brute(rows, 0.0)
    assert len(got) == 4
    agree(got.values(), {d: want[d] for d in got})


def test_many_buckets_and_common_words(spark, monkeypatch):
    """A third of all words are one word, and the grams of a block lie in many hash ranges."""
    monkeypatch.setattr(lm, "GRAMS_KEPT", 7)
    rows = [(i, " ".join(f"the w{(i * k) % 23} x{i}" for k in range(i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    agree(lm.score(df).collect(), brute(rows, 0.0))
