"""Ranks, positions, quantiles and firsts that no single task has to see whole.

A plain window over a hot group, or over no group at all, sorts everything in one task.
Here equal values are counted first, the distinct values are cut into ordered buckets, and
only the bucket totals (a row for each partition that a group reaches) are summed in sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order, as an aggregate that combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_named(order)))
    picked = df.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def _named(order: Sequence[str | Column]) -> list[Column]:
    return [
        (F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)
    ]


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group.

    Spark cuts every map task to ``k`` rows per group before the shuffle
    (``WindowGroupLimit``), so a hot group stays small.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def cumulative_counts(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Per group and distinct value: rows with it (``n``), below it (``before``), in all (``total``).

    The value counts are dealt out in order of group and value, so a group of any size and any
    narrow range of values is cut into as many buckets as it fills partitions. They are read
    three times and written to the shared folder once, together with their bucket.
    """
    order, by = list(order), list(by)
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in order])
    counts = df.where(present).groupBy(*by, *order).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts.repartitionByRange(buckets, *by, *order).withColumn("_bucket", F.spark_partition_id()))

    group = Window.partitionBy(*by)
    up_to = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy(*by, "_bucket")
        .agg(F.sum("n").alias("_in"))
        .select(
            *by,
            "_bucket",
            F.coalesce(F.sum("_in").over(up_to), F.lit(0)).alias("_start"),
            F.sum("_in").over(group).alias("total"),
        )
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("_below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, [*by, "_bucket"])
        .select(*by, *order, "n", (F.col("_start") + F.col("_below")).alias("before"), "total")
    )


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank within the group, ascending, ties sharing their mean rank."""
    ranks = cumulative_counts(df, [value], by).select(
        *by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out)
    )
    return df.join(ranks, [*by, value], "left")


def positions(df: DataFrame, order: Sequence[str], out: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """0-based place of each row; ``order`` has to tell all rows apart."""
    place = cumulative_counts(df, order, by).select(*by, *order, F.col("before").alias(out))
    return df.join(place, [*by, *order])


def index_keys(df: DataFrame, key: str, out: str) -> DataFrame:
    """Table of distinct keys with 0-based codes in sorted order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return cumulative_counts(keys, [key]).select(key, F.col("before").alias(out))


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles by linear interpolation; one output column per named quantile."""
    cum = cumulative_counts(df, [value], by)
    reach = F.col("before") + F.col("n")
    aggs, outs = [], []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("total") - 1)
        low = F.floor(place)
        high = F.least(low + 1, F.col("total") - 1)
        v = F.col(value).cast("double")
        aggs += [
            F.max(F.when((F.col("before") <= low) & (low < reach), v)).alias(f"_lo_{name}"),
            F.max(F.when((F.col("before") <= high) & (high < reach), v)).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_part_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_part_{name}")).alias(name))
    grouped = cum.groupBy(*by) if by else cum.groupBy()
    return grouped.agg(*aggs).select(*by, *outs)


def count_quantile(counts: DataFrame, value: str, q: float) -> DataFrame:
    """One-row quantile of a count column: equal counts are merged before the final step."""
    merged = counts.groupBy(value).agg(F.count("*").alias("_f"))
    return merged.agg(F.percentile(F.col(value), F.lit(q), F.col("_f")).alias("threshold"))
