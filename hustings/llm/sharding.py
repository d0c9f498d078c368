"""Shards of nearly equal size that keep equal texts together, by a minimax contiguous partition.

Groups of equal texts stand in the order of their digest and are never cut. The smallest
capacity with which a greedy walk over the groups fills no more than the wanted shards is found
by binary search, and the cuts are made under that capacity. DataFrame functions only: the
driver sees a histogram of a fixed number of bins and a handful of cuts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage_path
from .shared import query, table

SHARDS = 8
BINS = 8192  # rows of a histogram that reach the driver
LAW = "bytes"


class Atoms(NamedTuple):
    """Rows with their text's size and digest, and the groups in order with the bytes up to their ends."""

    rows: DataFrame  # doc_id, size, text_crc32, digest
    groups: DataFrame  # digest, end
    total: int
    largest: int


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def atoms(docs: DataFrame, text: str = "text") -> Atoms:
    """Sizes of the rows and running sums over the groups of equal texts.

    Texts are read once; what goes on is a narrow row for each. Group sizes combine before the
    shuffle, so a text that a third of the rows share is one row a task there. Running sums are
    taken inside ranges of digests, of which only the totals are summed in sequence.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = _stored(
        docs.select(
            "doc_id", (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
            F.md5(t.cast("binary")).alias("digest"),
        ),
        "sizes",
    )
    sums = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    ranges = _stored(sums.repartitionByRange("digest").withColumn("range", F.spark_partition_id()), "groups")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.sum("bytes").alias("_in")).select(
        "range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.withColumn("_upto", F.sum("bytes").over(inside)).join(F.broadcast(starts), "range")
    groups = _stored(ends.select("digest", (F.col("_start") + F.col("_upto")).alias("end")), "ends")
    seen = ranges.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    return Atoms(rows, groups, seen[0], seen[1])


# The search ------------------------------------------------------------------------------

class _Known:
    """What a histogram tells about the largest group end at or below a place."""

    def __init__(self, bins: Sequence[tuple[int, int, int]]):
        self.bins = sorted(bins)
        self.first = [b[0] for b in self.bins]

    def at_least(self, x: int) -> int:
        first, last, n = self.bins[bisect_right(self.first, x) - 1]
        return last if last <= x else first

    def at_most(self, x: int) -> int:
        first, last, n = self.bins[bisect_right(self.first, x) - 1]
        return last if last <= x else first if n <= 2 else x


def _walk(step: Callable[[int], int], capacity: int, shards: int) -> list[int]:
    """Where the greedy walk stands after each shard."""
    at, places = 0, []
    for _ in range(shards):
        at = step(at + capacity)
        places.append(at)
    return places


def _smallest(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """Smallest number over ``low`` for which ``holds``; it holds for ``high``."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _histogram(groups: DataFrame, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """First end, last end and number of ends of each bin; the bins share the spans evenly."""
    end, bins = F.col("end"), max(1, BINS // len(spans))
    place: Column = F.lit(None).cast("long")
    for k, (a, b) in enumerate(spans):
        width = max(1, -(-(b - a) // bins))
        place = F.when((end > a) & (end <= b), F.lit(k * (bins + 1)) + F.floor((end - F.lit(a + 1)) / F.lit(width))).otherwise(place)
    within = groups.where(" OR ".join(f"(end > {a} AND end <= {b})" for a, b in spans))
    rows = within.groupBy(place.alias("_bin")).agg(F.min("end"), F.max("end"), F.count("*")).collect()
    return [tuple(r[1:]) for r in rows] + [(a, a, 1) for a, _ in spans]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def smallest_capacity(cut_up: Atoms, shards: int) -> int:
    """Smallest size of the largest shard among all contiguous partitions into ``shards``.

    Each round counts group ends in bins. Where a bin hides whether the walk gets by, the walk is
    taken with the bin's first end and with its last place; capacities on which both agree are
    settled, and the next round's bins cover only the places the walk can reach with the others.
    """
    if not cut_up.total:
        return 0
    low = max(-(-cut_up.total // shards), cut_up.largest) - 1
    high = -(-cut_up.total // shards) + cut_up.largest
    spans = [(0, cut_up.total)]
    while high - low > 1:
        known = _Known(_histogram(cut_up.groups, spans))
        high = _smallest(low, high, lambda c: _walk(known.at_least, c, shards)[-1] >= cut_up.total)
        low = _smallest(low, high, lambda c: _walk(known.at_most, c, shards)[-1] >= cut_up.total) - 1
        least, most = _walk(known.at_least, low + 1, shards), _walk(known.at_most, high, shards)
        spans = _joined([(a, min(b, cut_up.total)) for a, b in zip(least, most) if a < cut_up.total])
    return high


def _ends(groups: DataFrame, below: Sequence[int], above: Sequence[int]) -> tuple[list[int], list[int]]:
    """Largest ends at or below places, and smallest ends at or above others; 0 is an end."""
    end = F.col("end")
    asked = [F.max(F.when(end <= F.lit(x), end)).alias(f"b{i}") for i, x in enumerate(below)]
    asked += [F.min(F.when(end >= F.lit(x), end)).alias(f"a{i}") for i, x in enumerate(above)]
    row = groups.agg(*asked).first()
    return [row[f"b{i}"] or 0 for i in range(len(below))], [0 if x <= 0 else row[f"a{i}"] for i, x in enumerate(above)]


def cuts(cut_up: Atoms, shards: int) -> list[int]:
    """Ends of all shards but the last, none over the smallest capacity.

    A shard ends at the group end nearest to an even share of what is left (the earlier one of
    two), but not so early that the rest no longer fits, and takes a group at least.
    """
    capacity, total = smallest_capacity(cut_up, shards), cut_up.total
    earliest = [total]
    for _ in range(shards - 1):
        need = earliest[-1] - capacity
        earliest.append(_ends(cut_up.groups, [], [need])[1][0] if need > 0 else 0)
    at, found = 0, []
    for left, need in zip(range(shards, 1, -1), earliest[:0:-1]):
        if at < total:
            share = at + (total - at) // left
            (before, most), (after,) = _ends(cut_up.groups, [share, at + capacity], [share + 1])
            near = after if before <= at or (after is not None and after - share < share - before) else before
            at = min(max(near, need), most)
        found.append(at)
    return found


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row; equal texts share a shard.

    A null text counts as empty, of size 1; rows with an empty text are one group. Rows without
    ``doc_id`` and repeated rows are placed like others, an empty table gives an empty result,
    and other columns are not looked at. Where the table has fewer groups than shards, the last
    shards stay empty. Slots follow digest and ``doc_id`` inside a shard: rows are sorted in
    ranges of both, so a hot text is dealt over several, and counts per range are summed.
    """
    cut_up = atoms(docs, text)
    ends = cuts(cut_up, shards)
    last = {r["end"]: r["digest"] for r in cut_up.groups.where(F.col("end").isin(ends or [0])).collect()}
    shard = F.lit(0)
    for end in ends:
        shard = shard + (F.col("digest") > F.lit(last.get(end, ""))).cast("int")
    dealt = cut_up.rows.repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    placed = _stored(
        dealt.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.monotonically_increasing_id().alias("_at")), "placed"
    ).withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        "shard", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    slot = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(F.broadcast(starts), ["shard", "_range"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


# The same in SQL ---------------------------------------------------------------------------

def _sql(shards: int) -> str:
    """Capacity by dynamic programming over all cuts, then one cut after the other."""
    parts = [
        """bits AS (SELECT range AS n FROM range(256)),
        crc_table AS (SELECT list(c ORDER BY n) AS ct FROM (
          SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM bits)),
        sized AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, hex(encode(coalesce(text, ''))) AS h FROM documents),
        checked AS MATERIALIZED (SELECT digest, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
            lambda x, y: xor(ct[xor(x & 255, y) + 1], x >> 8)), 4294967295) AS crc
          FROM (SELECT DISTINCT digest, h FROM sized), crc_table),
        ends AS MATERIALIZED (SELECT digest, CAST(sum(sum(size)) OVER (ORDER BY digest) AS BIGINT) AS e FROM sized GROUP BY digest),
        w AS MATERIALIZED (SELECT CAST(coalesce(max(e), 0) AS BIGINT) AS total FROM ends),
        f1 AS MATERIALIZED (SELECT e, e AS c FROM ends UNION ALL SELECT 0, 0)"""
    ]
    for k in range(2, shards + 1):
        parts.append(
            f"f{k} AS MATERIALIZED (SELECT a.e, min(greatest(b.c, a.e - b.e)) AS c FROM f1 AS a JOIN f{k - 1} AS b ON b.e <= a.e GROUP BY a.e)"
        )
    parts.append(f"cap AS MATERIALIZED (SELECT c AS cap FROM f{shards}, w WHERE e = total)")
    parts.append(f"q{shards} AS (SELECT total AS q FROM w)")
    for k in range(shards - 1, 0, -1):
        parts.append(f"q{k} AS MATERIALIZED (SELECT (SELECT min(e) FROM f1 WHERE e >= q - cap) AS q FROM q{k + 1}, cap)")
    parts.append("p0 AS (SELECT 0::BIGINT AS p)")
    for k in range(1, shards):
        left = shards - k + 1
        parts.append(
            f"""s{k} AS MATERIALIZED (SELECT p, cap, q, total, p + (total - p) // {left} AS share FROM p{k - 1}, cap, q{k}, w),
            n{k} AS MATERIALIZED (SELECT *, (SELECT max(e) FROM f1 WHERE e <= share) AS b, (SELECT min(e) FROM f1 WHERE e > share) AS a,
                    (SELECT max(e) FROM f1 WHERE e <= p + cap) AS most FROM s{k}),
            p{k} AS MATERIALIZED (SELECT CASE WHEN p >= total THEN p ELSE least(greatest(CASE WHEN b <= p OR a - share < share - b THEN a ELSE b END, q), most) END AS p FROM n{k})"""
        )
    passed = " + ".join(f"CAST(e > (SELECT p FROM p{k}) AS INTEGER)" for k in range(1, shards))
    return (
        "WITH " + ", ".join(parts) + f""", placed AS (SELECT *, {passed} AS shard FROM sized JOIN ends USING (digest) JOIN checked USING (digest))
    SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, '{LAW}' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM placed"""
    )


@query(_sql(SHARDS))
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
