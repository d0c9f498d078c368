"""Every registered query: same columns and values as its SQL, and no join of all with all."""

import contextlib
import io

import check
import duckdb
import pytest

from hustings import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    got = check.rows_of(df.columns, df.collect())
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "CartesianProduct" not in out.getvalue()
    assert "BroadcastNestedLoopJoin" not in out.getvalue()
    if q.sql is None:
        assert got
        return
    res = db.execute(q.sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == check.rows_of(cols, res.fetchall())


def test_every_query_names_what_it_covers():
    assert all(q.covers for q in QUERIES.values())
