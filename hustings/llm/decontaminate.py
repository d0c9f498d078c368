"""Benchmark items found in documents by templates: slots for numbers, names and units, checked for consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import free_name, mixed, pieces, query, table, window_hashes

WINDOW = 8  # words of a template window
LITERAL = 5  # words of a window that have to be the words themselves
SHARE = 0.25  # part of an item's windows that has to be found
FILTER_BITS = 1 << 22  # size of the filter sent to the executors, whatever the benchmark's size
WORDS_KEPT = 500_000

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s ms min h hz khz mhz ghz kb mb gb tb w kw kwh v a j kj k c f mph kmh "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms ton tons pound pounds ounce ounces liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros pence percent degree degrees watt watts volt volts joule joules".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?$")
_NUMBER_UNIT = re.compile(r"[+-]?\d[\d.,:/]*(?:[a-z%°]{1,3})$")
_EDGES = re.compile(r"^\W+|\W+$")
_ENDS = re.compile(r"[.!?:…][\"'”’»)\]]*$")

_CAPITAL, _END, _NUM, _UNIT = 1, 2, 4, 8
_SLOT = {"number": np.uint64(0x1B873593A5D1E6F1), "unit": np.uint64(0x38B34AE5C93D1E07), "name": np.uint64(0x52DCE729F0A3B1C9)}


class _Words(dict):
    """Number of each word as written; its hash and its marks stand in arrays that grow."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.marks = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def __missing__(self, raw: str) -> int:
        bare = _EDGES.sub("", raw)
        if not bare and "%" in raw:
            bare = "%"
        low = bare.lower()
        marks = (_CAPITAL if bare[:1].isupper() else 0) | (_END if _ENDS.search(raw) else 0)
        if low in NUMBER_WORDS or _NUMBER.match(low) or _NUMBER_UNIT.match(low):
            marks |= _NUM
        elif low in UNITS or low == "%":
            marks |= _UNIT
        n = len(self)
        if n == len(self.hashes):
            self.hashes, self.marks = np.append(self.hashes, np.zeros_like(self.hashes)), np.append(self.marks, np.zeros_like(self.marks))
        self.hashes[n] = xxhash.xxh3_64_intdigest(low) if low else 0
        self.marks[n] = marks
        self[raw] = n
        return n


def templates(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``template, value, is_slot`` of the words of a text.

    A number is a slot; so is a unit after a number, and a capitalised word that doesn't begin a
    sentence. Other words are themselves. Case and punctuation at the edges of words don't matter.
    The values of names are odd, all others even.
    """
    of = np.array([words[w] for w in (text or "").split()], np.int64)
    if not len(of):
        empty = np.empty(0, np.uint64)
        return empty, empty, empty.astype(bool)
    value = words.hashes[of]
    marks = words.marks[of]
    begins = np.concatenate([[True], (marks[:-1] & _END) > 0])
    named = value != 0
    value, marks, begins = value[named], marks[named], begins[named]
    number = (marks & _NUM) > 0
    unit = ((marks & _UNIT) > 0) & np.concatenate([[False], number[:-1]])[: len(number)]
    name = ((marks & _CAPITAL) > 0) & ~begins & ~number & ~unit
    template = value.copy()
    for is_kind, slot in ((number, "number"), (unit, "unit"), (name, "name")):
        template[is_kind] = _SLOT[slot]
    value = value & ~np.uint64(1) | name.astype(np.uint64)
    return template, value, number | unit | name


def _windows(text: str | None, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, place`` of the windows of a text that have enough words of their own, with values and slots."""
    template, value, slot = templates(text, words)
    found = window_hashes(template, WINDOW)
    if not len(found):
        return found, np.empty(0, np.int64), value, slot
    slots = np.concatenate([[0], np.cumsum(slot)])
    enough = WINDOW - (slots[WINDOW:] - slots[:-WINDOW]) >= LITERAL
    places = np.flatnonzero(enough)
    return found[places], places, value, slot


def _rows(df: DataFrame, key: str, text: str, bits: np.ndarray | None) -> DataFrame:
    """``id, hash, place, n_windows, values`` of all windows, or of those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in pieces(batches, "text"):
            if len(words) > WORDS_KEPT:
                words = _Words()
            ids, hashes, at, total, values = [], [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found, places, value, slot = _windows(t, words)
                n = len(found)
                if bits is not None and n:
                    bit = found & np.uint64(FILTER_BITS - 1)
                    hit = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    found, places = found[hit], places[hit]
                for h, p in zip(found.view(np.int64).tolist(), places.tolist()):
                    ids.append(i)
                    hashes.append(h)
                    at.append(p)
                    total.append(n)
                    values.append(value[p : p + WINDOW][slot[p : p + WINDOW]].view(np.int64))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(values, pa.list_(pa.int64()))],
                ["id", "hash", "place", "n_windows", "values"],
            )

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    return rows.mapInArrow(run, "id long, hash long, place long, n_windows long, values array<long>")


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """A bit for the low end of each hash: FILTER_BITS / 8 bytes at any size of the benchmark.

    A full filter lets more rows on to the join and nothing else.
    """
    low = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    bit = F.expr("shiftleft(1L, cast(hash & 31 AS int))")
    words = windows.groupBy(F.shiftright(low, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def agreeing(windows: list[dict]) -> list[dict]:
    """The windows of a stretch whose slots agree with its mapping of values to values.

    The mapping is one to one. Pairs enter it by the number of windows they are in, names that
    are kept before others. Windows with a pair that isn't in it are dropped, and no others, as
    numbers can be equal by chance and a copy can be edited in a place. Names changed to
    different names, or to one, are another text: of that only windows without slots are left.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    for w in windows:
        for pair in set(zip(w["own"], w["there"])):
            seen.setdefault(pair, [0, w["at"]])[0] += 1
            seen[pair][1] = min(seen[pair][1], w["at"])
    there, own = {}, {}
    other = False
    for a, b in sorted(seen, key=lambda p: (not (p[0] & 1 and p[0] == p[1]), -seen[p][0], p[0] != p[1], seen[p][1], p)):
        if a not in there and b not in own:
            there[a], own[b] = b, a
        elif a & 1:
            # The pairs in the way: those that keep the name are the copy, with an edit here.
            other |= there.get(a, a) != a or own.get(b, b) != b
    if other:
        return [w for w in windows if not w["own"]]
    return [w for w in windows if all(there.get(a) == b for a, b in zip(w["own"], w["there"]))]


def _settled(runs: DataFrame) -> DataFrame:
    """``runs`` with the windows that agree in place of all, where ``_windows`` is given."""
    names = ["id", "_item", "_n", "_found", "_from", "_to", "_same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c).to_pylist() for c in names}
            for i, windows in enumerate(batch.column("_windows")):
                if windows.is_valid:
                    kept = agreeing(windows.as_py())
                    places = [w["place"] for w in kept]
                    out["_found"][i] = sorted({w["at"] for w in kept})
                    out["_from"][i], out["_to"][i] = min(places, default=None), max(places, default=None)
                    out["_same"][i] = False
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(out[c], k) for c, k in zip(names, kinds)], names)

    return runs.select(*names, "_windows").mapInArrow(
        run, "id long, _item long, _n long, _found array<long>, _from long, _to long, _same boolean"
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = SHARE, key: str = "doc_id", item: str = "item_id", text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, n_found, n_windows, verbatim, first_word, last_word`` of items found in documents.

    Windows of template words are met by hash. Where a document and an item share windows at the
    same distance, the values in the slots have to agree: one value of the item always stands
    for the same value in the document, and two values never for one. Windows that don't agree
    with most others are dropped; where names are changed without agreeing, all windows with
    slots are. An item is found when ``share`` of its windows are; ``verbatim`` tells whether all
    slots have the item's own values. Words are counted from 0, without bare punctuation.

    Items of fewer than 8 words have no window and are never found. Null texts have none, rows
    without an id are left out, rows that share an id count as one document or item, other
    columns are ignored, empty tables give no rows.
    """
    own = _rows(benchmark.select(F.col(item).alias("_i"), F.col(text).alias("_t")), "_i", "_t", None)
    bits = _filter_bits(own)
    there = _rows(docs.select(F.col(key).alias("_i"), F.col(text).alias("_t")), "_i", "_t", bits)
    items = own.select(F.col("id").alias("_item"), "hash", F.col("place").alias("_at"), F.col("n_windows").alias("_n"), F.col("values").alias("_own")).distinct()
    both = there.select("id", "hash", "place", "values").join(items, "hash")
    slots = F.arrays_zip(F.col("_own").alias("own"), F.col("values").alias("there"))
    runs = both.groupBy("id", "_item", (F.col("place") - F.col("_at")).alias("_shift")).agg(
        F.collect_set("_at").alias("_found"), F.max("_n").alias("_n"), F.min("place").alias("_from"), F.max("place").alias("_to"),
        F.array_distinct(F.flatten(F.collect_list(slots))).alias("_slots"),
        F.collect_set(F.struct(F.col("_at").alias("at"), "place", F.col("_own").alias("own"), F.col("values").alias("there"))).alias("_windows"),
    )
    n = F.size("_slots")
    one_to_one = (F.size(F.array_distinct(F.transform("_slots", lambda s: s["own"]))) == n) & (
        F.size(F.array_distinct(F.transform("_slots", lambda s: s["there"]))) == n
    )
    same = F.forall("_slots", lambda s: s["own"] == s["there"])
    settled = _settled(runs.withColumns({"_same": same, "_windows": F.when(~one_to_one, F.col("_windows"))}))
    found = settled.where(F.size("_found") > 0).groupBy("id", "_item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_found")))).cast("long").alias("n_found"), F.max("_n").alias("n_windows"),
        F.every("_same").alias("verbatim"), F.min("_from").alias("first_word"), (F.max("_to") + WINDOW - 1).alias("last_word"),
    )
    return found.where(F.col("n_found") >= share * F.col("n_windows")).select(
        F.col("id").alias(key), F.col("_item").alias(item), "n_found", "n_windows", "verbatim", "first_word", "last_word"
    )


def without_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows of ``docs`` in which no item is found, with all their columns."""
    name = free_name(docs, "_found")
    found = contaminated(docs, benchmark, share).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(name), "left_anti")


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, verbatim or with other numbers, names and units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
