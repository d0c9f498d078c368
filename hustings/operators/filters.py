"""Row filters, routing, code lists and reports on dropped rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def drop_prefixes(df: DataFrame, col: str, prefixes: Sequence[str] = fixed.PROCEDURAL_SPEAKERS) -> DataFrame:
    """Drop rows whose column starts with one of the prefixes, case aside; NULL stays."""
    led = _any([F.lower(F.col(col)).startswith(p) for p in prefixes])
    return df.where(~F.coalesce(led, F.lit(False)))


def min_length(df: DataFrame, col: str, n: int = fixed.MIN_SPEECH_CHARS) -> DataFrame:
    return df.where(F.char_length(F.col(col)) >= n)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def assert_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def contains_any(df: DataFrame, col: str, terms: Sequence[str] = fixed.BILL_TERMS) -> DataFrame:
    upper = F.upper(F.col(col))
    return df.where(_any([F.contains(upper, F.lit(t.upper())) for t in terms]))


def not_contains(df: DataFrame, col: str, term: str) -> DataFrame:
    """Drop rows that hold the term, case aside; NULL holds no term."""
    return df.where(~F.coalesce(F.contains(F.lower(F.col(col)), F.lit(term.lower())), F.lit(False)))


def drop_report(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after a filter and the share dropped (NULL of no rows), in one pass."""
    kept = F.count_if(keep)
    return df.agg(F.count("*").alias("before"), kept.alias("after")).select(
        "before",
        "after",
        F.try_divide((F.col("before") - F.col("after")) * 100, F.col("before")).alias("pct_dropped"),
    )


def alias_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "found string, kept string")


def apply_aliases(
    df: DataFrame, col: str, aliases: Sequence[tuple[str, str]] | DataFrame, drop: str | None = None
) -> DataFrame:
    """Replace exact values, then drop one value; NULL stays.

    A short list of pairs becomes one expression, a table of pairs a join.
    """
    if isinstance(aliases, DataFrame):
        pairs = aliases.select(F.col("found").alias(col), F.col("kept").alias("_kept"))
        df = df.join(pairs, col, "left").withColumn(col, F.coalesce("_kept", col)).drop("_kept")
    else:
        out = None
        for found, kept in aliases:
            hit = F.col(col) == F.lit(found)
            out = F.when(hit, kept) if out is None else out.when(hit, kept)
        df = df.withColumn(col, out.otherwise(F.col(col)))
    if drop is not None:
        df = df.where(F.coalesce(F.col(col) != drop, F.lit(True)))
    return df


def target_of(subtopic_2: Column | str = "subtopic_2") -> Column:
    c = F.col(subtopic_2) if isinstance(subtopic_2, str) else subtopic_2
    return F.when((c != fixed.MISC) & (c != ""), c)


def pick_target(df: DataFrame, col: str = "subtopic_2", out: str = "target") -> DataFrame:
    """The finest topic that says something; NULL for ``Misc.`` and for none."""
    return df.withColumn(out, target_of(col))


def drop_misc(df: DataFrame, col: str = "subtopic_2") -> DataFrame:
    return df.where(target_of(col).isNotNull())


def drop_noise(df: DataFrame, col: str = "label") -> DataFrame:
    return df.where(F.col(col) != -1)


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def load_scores(df: DataFrame, congress: int = fixed.CONGRESS) -> DataFrame:
    """External score table of one congress: members of the two chambers, codes translated."""
    return (
        df.where((F.col("congress") == congress) & F.col("chamber").isin(*fixed.SCORE_CHAMBERS))
        .withColumn("chamber", text.map_codes("chamber", fixed.SCORE_CHAMBERS))
        .withColumn("lastname", F.coalesce(text.roster_lastname("bioname", upper=False), F.lit("")))
        .withColumn("party", text.map_codes("party_code", fixed.PARTY_CODES, "UNK"))
    )


def with_row_id(df: DataFrame, key: Sequence[str] = (), out: str = "row_id", seed: int = 42) -> DataFrame:
    """Stable row id: a hash of the natural key (or the whole row), the same in every run."""
    cols = list(key) or df.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return df.withColumn(out, F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *parts)))


def ensure_doc_id(df: DataFrame, parts: Sequence[str], out: str = "document_id") -> DataFrame:
    """Keep the document id where there is one, else build it from its parts."""
    made = F.concat_ws("_", *[F.col(p).cast("string") for p in parts])
    given = F.col(out).cast("string") if out in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(given, made))
