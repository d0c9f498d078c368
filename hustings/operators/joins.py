"""Joins against small per-group tables that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

def salted_join(big: DataFrame, groups: DataFrame, on: Sequence[str], spread: Sequence[str | Column]) -> DataFrame:
    """Inner join of rows with a table of few rows per group, hot groups cut into parts.

    A group with more rows than a partition has on average is cut into as many parts as it would
    fill partitions. There are at most as many such groups as partitions, so their list is small
    enough to broadcast at any size. The part of a row follows from a hash of ``spread``, so a
    task that runs again sends it to the same place.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = big.groupBy(*on).agg(F.count("*").alias("_n"))
    filled = F.col("_n") * parts / sizes.agg(F.sum("_n")).scalar()
    hot = sizes.where(filled > 1).select(*on, F.ceil(filled).cast("int").alias("_parts"))
    left = big.join(F.broadcast(hot), list(on), "left")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = groups.join(F.broadcast(hot), list(on), "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return left.join(right.withColumn("_salt", every).drop("_parts"), [*on, "_salt"]).drop("_salt")


def per_distinct_text(
    df: DataFrame, col: str, work: Callable[[DataFrame], DataFrame], out: str
) -> DataFrame:
    """Result of ``work`` for each row's text, worked out once per distinct text.

    Texts meet again by their digest, so long texts are not shuffled a second time as keys.
    """
    keyed = df.withColumn("_digest", F.md5(F.col(col)))
    distinct = (
        keyed.where(F.col(col).isNotNull()).groupBy("_digest").agg(F.any_value(col).alias(col))
    )
    return keyed.join(work(distinct).select("_digest", out), "_digest", "left").drop("_digest")
