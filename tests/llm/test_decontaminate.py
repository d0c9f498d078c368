import pytest

from hustings.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"
QUESTION = (
    "A baker named Natalia sold 48 loaves to her friend Omar in April and then Natalia sold half as many loaves in May. "
    "If each loaf weighs 500 grams, how many kilograms of bread did Natalia sell to Omar altogether?"
)


def test_query_against_brute_force(spark):
    """Items that stand in a document word by word are found, and nothing that shares no window."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in dc.op1_decontaminate(spark, SF).collect()}
    plain = lambda t: [w.strip(".,").lower() for w in t.split()]
    whole = {(d, i) for d, t in docs.items() for i, q in items.items() if f" {' '.join(plain(q))} " in f" {' '.join(plain(t))} " and len(plain(q)) >= 10}
    assert whole and whole <= got.keys()
    assert all(got[k].n_found >= 0.5 * got[k].n_windows for k in whole)
    for (d, i), r in got.items():
        w, q = plain(docs[d]), plain(items[i])
        parts = {tuple(q[k : k + 4]) for k in range(len(q) - 3)}
        assert any(tuple(w[k : k + 4]) in parts for k in range(len(w) - 3))


def variant(names, numbers):
    out = QUESTION
    for a, b in names.items():
        out = out.replace(a, b)
    for a, b in numbers.items():
        out = out.replace(a, b)
    return out


@pytest.mark.parametrize(
    "text, found, verbatim",
    [
        (QUESTION, True, True),
        (QUESTION.upper(), False, None),
        (variant({"Natalia": "Bob", "Omar": "Wei"}, {"48": "1,250", "500": "3.5"}), True, False),
        (variant({}, {"grams": "ounces"}), True, False),
        # One name for both people, or one person with changing names: another question.
        (variant({"Natalia": "Bob", "Omar": "Bob"}, {}), False, None),
        ("A baker named Ann sold 48 loaves to her friend Omar in April and then Bob sold half as many loaves in May. "
         "If each loaf weighs 500 grams, how many kilograms of bread did Cid sell to Omar altogether?", False, None),
        ("Other text that has nothing to do with the question but is as long as it, with 48 loaves sold in May.", False, None),
    ],
)
def test_slots(spark, text, found, verbatim):
    filler = "some words before it and after it that mean nothing at all"
    docs = spark.createDataFrame([(1, f"{filler}. {text} {filler}", 5)], "doc_id long, text string, n_windows int")
    bench = spark.createDataFrame([(9, QUESTION)], "item_id long, text string")
    got = dc.contaminated(docs, bench).collect()
    assert bool(got) == found
    if found:
        assert got[0].verbatim == verbatim and got[0].item_id == 9 and got[0].first_word >= 12


SHOP = (
    "On Monday a farmer called Natalia packed 3 apples into a wooden box and later put 3 pears into the same box for the "
    "school. Every child who came by was given 5 grapes and a slice of bread with cheese. How much fruit did Natalia pack?"
)


@pytest.mark.parametrize(
    "changes, found",
    [
        # Numbers equal by chance: one becomes two, two become one; and a copy with one edit.
        ({"3 apples": "4 apples", "3 pears": "7 pears"}, True),
        ({"5 grapes": "3 grapes"}, True),
        ({"3 pears": "8 pears"}, True),
        ({"did Natalia": "did Olga"}, True),
        ({"called Natalia": "called Bob", "did Natalia": "did Olga"}, False),
    ],
)
def test_windows_that_conflict_go_alone(spark, changes, found):
    text = SHOP
    for a, b in changes.items():
        assert a in text
        text = text.replace(a, b)
    docs = spark.createDataFrame([(1, f"Some words before it. {text} And after it.")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, SHOP)], "item_id long, text string")
    got = dc.contaminated(docs, bench).collect()
    if found:
        assert len(got) == 1 and not got[0].verbatim and 0.25 * got[0].n_windows <= got[0].n_found < got[0].n_windows
    else:
        assert not got or got[0].n_found < 0.5 * got[0].n_windows


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, QUESTION), (3, QUESTION), (3, QUESTION), (4, "x " * 200_000 + QUESTION), (5, "too short")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, QUESTION), (2, QUESTION), (1, QUESTION), (None, QUESTION), (3, None), (4, "too short")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect())
    assert got == [(3, 1), (3, 2), (4, 1), (4, 2)]
    assert sorted(r.doc_id or 0 for r in dc.without_items(docs, bench).collect()) == [0, 1, 2, 5]
    assert dc.contaminated(docs.limit(0), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    import numpy as np

    monkeypatch.setattr(dc, "_filter_bits", lambda w: np.full(dc.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == want
