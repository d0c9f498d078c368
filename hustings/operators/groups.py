"""Counts, coverage, shares and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import cumulative_counts, first_by, top_per_group


def count_crosstab(df: DataFrame, key: str, col: str, values: Sequence[str]) -> DataFrame:
    """Rows per key and value side by side, with their total."""
    counts = [F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values]
    out = df.groupBy(key).agg(*counts)
    return out.withColumn("total", sum((F.col(f"n_{v}") for v in values[1:]), F.col(f"n_{values[0]}")))


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("count"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once."""
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(again, key, "left_semi")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def label_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and percent per label, within each of ``by``.

    The window sees one row per label, the rows themselves having been counted before.
    """
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("pct", F.try_divide(F.col("n") * 100, whole))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Minimum, maximum, mean, median and quantiles of a count column, in one row."""
    merged = df.groupBy(col).agg(F.count("*").alias("_f"))
    qs = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    found = F.percentile(F.col(col), F.array(*[F.lit(q) for q in qs.values()]), F.col("_f"))
    return merged.agg(
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.try_divide(F.sum(F.col(col) * F.col("_f")), F.sum("_f")).alias("mean"),
        found.alias("_q"),
    ).select("min", "max", "mean", *[F.col("_q")[i].alias(name) for i, name in enumerate(qs)])


def share(df: DataFrame, value: str, parent: Sequence[str]) -> DataFrame:
    """Percent of the parent's sum and of the whole."""
    total = df.agg(F.sum(value)).scalar()
    sums = df.groupBy(*parent).agg(F.sum(value).alias("_p"))
    return (
        df.join(sums, list(parent))
        .withColumns(
            {
                "pct_of_parent": F.try_divide(F.col(value) * 100, F.col("_p")),
                "pct_of_total": F.try_divide(F.col(value) * 100, total),
            }
        )
        .drop("_p")
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sample_hash(key: Column | str, seed: int = 42) -> Column:
    """Hash that any engine can recompute, by which samples and splits are drawn."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def sample_n(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows, all rows when there are fewer."""
    h = sample_hash(key, seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def random_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``split``, train or test, by a hash of the key."""
    part = F.conv(F.left(sample_hash(key, seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(part < train, "train").otherwise("test"))


def stratified_split(
    df: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42
) -> DataFrame:
    """Adds ``split``: per label the first 80% in hash order, the next 10%, the rest.

    All rows of one key go to one split. Labels are few and large, so places within a label
    are counted over hash ranges instead of by sorting the label in one task.
    """
    keys = first_by(df.select(key, label), [key], [label]).withColumn("_h", sample_hash(key, seed))
    place = cumulative_counts(keys.withColumn("_k", F.col(key)), ["_h", "_k"], [label])
    n_train = F.floor(F.col("total") * F.lit(train))
    n_val = F.floor(F.col("total") * F.lit(val))
    split = (
        F.when(F.col("before") < n_train, "train")
        .when(F.col("before") < n_train + n_val, "val")
        .otherwise("test")
    )
    return df.join(place.select(F.col("_k").alias(key), split.alias("split")), key)


def extremes(df: DataFrame, name: str, cols: Sequence[str], order: str) -> DataFrame:
    """Who is lowest and highest on each measure, first in order on ties."""
    aggs = []
    for c in cols:
        aggs.append(F.min_by(name, F.struct(F.col(c), F.col(order))).alias(f"min_{c}"))
        aggs.append(F.min_by(name, F.struct(-F.col(c), F.col(order))).alias(f"max_{c}"))
    return df.where(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0).agg(*aggs)


def group_targets(
    df: DataFrame, by: str, order: str, fields: Sequence[str], k: int = 3
) -> DataFrame:
    """First ``k`` entries of each group as arrays; short groups repeat their first entry.

    ``valid`` marks what is genuine. Only the first ``k`` rows of a group are ever gathered.
    """
    first = top_per_group(df, [by], [F.col(order)], k, "_place")
    rows = first.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("_place", *fields))).alias("_rows")
    )
    have = F.size("_rows")
    pad = F.array_repeat(F.col("_rows")[0], F.lit(k) - have)
    full = rows.withColumns(
        {
            "_all": F.concat("_rows", pad),
            "valid": F.concat(F.array_repeat(F.lit(1), have), F.array_repeat(F.lit(0), F.lit(k) - have)),
        }
    )
    return full.select(
        by, *[F.col(f"_all.{f}").alias(f) for f in fields], "valid"
    )
