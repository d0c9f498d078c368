import contextlib
import io

import check
import duckdb
import pytest
from pyspark.sql import functions as F

from hustings.llm import catalog, quality_rules as qr

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in catalog.load().items() if q.sql])
def test_queries_against_their_sql(spark, name):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = catalog.load()[name]
    df, res = q.run(spark, SF), db.execute(q.sql)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([d[0] for d in res.description], res.fetchall())


def test_plan_is_native(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        qr.op7_quality_rules(spark, SF).explain()
    assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow", "Exchange"))


def measures(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words string, failed_bits int")
    return {r.doc_id: r for r in qr.ledger(df).collect()}


def test_measures(spark):
    run = "one two three four five"
    got = measures(spark, [None, "", " \t\n\x0b\x0c\r ", f"{run} {run}", f"{run} six {run}", "a a a a a a a", "x\n\nx\n y\nx ", "é# $b| c", "w " * 60_000, f"{run} five"])
    words = [0, 0, 0, 10, 11, 7, 4, 2, 60_000, 6]
    assert [got[i].n_words for i in range(10)] == words
    assert [got[i].n_repeat_words for i in range(10)] == [0, 0, 0, 10, 10, 7, 0, 0, 60_000, 0]
    assert (got[6].n_lines, got[6].n_dup_lines) == (4, 1)
    assert (got[7].word_chars, got[7].n_symbols) == (7, 3)  # the hard blank belongs to its word
    assert got[1].failed_bits == qr.bit("few_words") and got[0].failed_bits == got[1].failed_bits


def test_policies_and_ablations(spark):
    rows = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 0)]
    df = spark.createDataFrame(rows, "doc_id int, failed_bits long")
    assert {r.doc_id for r in df.where(qr.accepts(1)).collect()} == {1, 5, 6}
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in qr.ablations(df, 1).collect()}
    assert got == {"few_words": (2, 1, 4), "repeated_windows": (2, 1, 4)}
    assert qr.mask(2) > qr.mask(1)


def test_accepted_rows_keep_all_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, good, "a"), (1, good, "a"), (2, "short", "b"), (None, None, "c")], "doc_id long, text string, n_words string")
    df = df.withColumn("_row", F.lit("r")).withColumn("_text", F.lit("t"))
    out = qr.accepted(df, 2)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "a", "r", "t")] * 2
    assert qr.accepted(df.limit(0), 2).count() == 0
