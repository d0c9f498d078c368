import json

import pytest

from hustings.operators import filters, resolve
from hustings.sources import tables


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a", 'one\n"two", three'), ("b", None)], "k string, speech string")
    tables.write_table(df, str(tmp_path / "x"), str(tmp_path / "y"), fmt="csv")
    for place in ("x", "y"):
        back = {r.k: r.speech for r in tables.read_table(spark, str(tmp_path / place), "k string, speech string").collect()}
        assert back == {"a": 'one\n"two", three', "b": None}


def test_bill_dictionary(spark, tmp_path):
    (tmp_path / "bills.json").write_text(json.dumps({"x act": {"title": "X Act", "bill_type": "HR", "bill_number": "1"}}) + "\n")
    row = tables.read_bills(spark, str(tmp_path / "bills.json")).first()
    assert (row.standardized_title, row.bill_type, row.bill_number) == ("x act", "HR", "1")


def test_splits_go_to_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id int, split string")
    tables.write_splits(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("split=*")} == {"split=train", "split=val", "split=test"}


def test_cache_asks_only_for_what_it_misses(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "id int, t string")
    cache = spark.createDataFrame([(1, "A")], "id int, label string")
    rows, fresh = tables.with_cache(df, cache, "id", lambda d: d.selectExpr("id", "upper(t) AS label"))
    assert sorted(r.id for r in fresh.collect()) == [2, 3]
    assert sorted(r.label for r in rows.collect()) == ["A", "B", "B", "C"]


def test_misses_are_worked_out_once_and_kept(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def label(rows):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b.assign(label=b["t"].str.upper())[["id", "label"]]

        return rows.mapInPandas(run, "id int, label string")

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "d")], "id int, t string")
    path = str(tmp_path / "cache")
    tables.write_table(spark.createDataFrame([(1, "A")], "id int, label string"), path)
    for asked in (2, 0):
        before = calls.value
        cache = spark.read.parquet(path)
        rows, fresh = tables.with_cache(df, cache, "id", label)
        assert sorted(str(r.label) for r in rows.collect()) == ["A", "B", "B", "C", "None"]
        tables.write_table(fresh, path, mode="append")
        assert calls.value - before == asked


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="chamber"):
        filters.assert_columns(spark.range(1), ["chamber"])


def test_alias_order(spark):
    rows = [
        ("t", "hr", 1, None, "2022-01-01", 1), ("t", "hr", 2, "2021-01-01", "2020-01-01", 2),
        ("t", "hr", 3, "2021-01-01", "2023-01-01", 3), ("u", "s", 4, None, "2020-01-01", 4), ("u", "s", 5, None, "2021-01-01", 5),
        ("u", "s", 6, None, "2021-01-01", 6),
    ]
    df = spark.createDataFrame(rows, "title string, bill_type string, bill_number int, s string, u string, seen int")
    df = df.selectExpr("title", "bill_type", "bill_number", "CAST(s AS DATE) summary_date", "CAST(u AS DATE) update_date", "seen")
    assert {r.title: r.bill_number for r in resolve.resolve_aliases(df).collect()} == {"t": 2, "u": 5}


def test_last_node_wins_a_document(spark):
    docs = spark.createDataFrame([(1, "Health"), (2, "Taxes")], "doc_id int, policy_area string")
    nodes = spark.createDataFrame(
        [(1, "Health", "a", "b", 1), (1, "Health", "c", "d", 2), (2, "Taxes", "e", "f", 1), (2, "Health", "g", "h", 3)],
        "doc_id int, policy_area string, subtopic_1 string, subtopic_2 string, node_pos int",
    )
    got = {r.doc_id: r.subtopic_1 for r in resolve.merge_taxonomy(docs, nodes).collect()}
    assert got == {1: "c", 2: None}


def test_roster_rules(spark):
    roster = spark.createDataFrame(
        [("McCONNELL", "S", "R", "KY", 1), ("SMITH", "H", "D", "WA", 2), ("SMITH", "H", "R", "NJ", 3)],
        "speaker string, chamber string, party string, state string, roster_pos int",
    )
    asked = [("Mr. MCCONNELL", "S"), ("Ms. SMITH of NJ", "House"), ("Ms. SMITH", "H"), ("Mr. RYAN", "S"), (None, None)]
    people = spark.createDataFrame(asked, "speaker string, chamber string")
    got = {r.speaker: (r.chamber, r.party) for r in resolve.match_roster(people, roster).collect()}
    assert got == {
        "Mr. MCCONNELL": ("S", "R"), "Ms. SMITH of NJ": ("H", "R"), "Ms. SMITH": ("H", "UNK"), "Mr. RYAN": ("H", "D"), None: ("H", "UNK"),
    }
    strict = {r.speaker: r.party for r in resolve.match_roster(people, roster, exact=True).collect()}
    assert strict["Mr. MCCONNELL"] == "UNK"
