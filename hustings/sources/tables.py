"""Reading and writing the tables that stages hand to each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text
from ..session import cut_lineage

BILL = "struct<title:string,bill_type:string,bill_number:string,updateDate:string,latest_summary:string,latest_summary_date:string>"
MEMBER = "struct<name:string,partyName:string,state:string,terms:struct<item:array<struct<chamber:string>>>>"


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: str, fmt: str = "csv", line_breaks: bool = True
) -> DataFrame:
    """Table with a declared schema; text formats carry a header.

    Quoted fields may hold line breaks. Files of tables that have none can be cut up between
    tasks, which ``line_breaks=False`` allows.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=line_breaks, escape='"')
    return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def read_many(
    spark: SparkSession, paths: Sequence[str], schema: str, fmt: str = "csv", line_breaks: bool = True
) -> DataFrame:
    """Several files of one layout as one table."""
    return read_table(spark, list(paths), schema, fmt, line_breaks)


def bills_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows of ``{title: bill}`` dictionaries to one row per title."""
    entries = F.explode(F.map_entries(F.from_json(F.col(col), f"map<string,{BILL}>")))
    return df.select(entries.alias("e")).select(F.col("e.key").alias("standardized_title"), "e.value.*")


def read_bills(spark: SparkSession, path: str) -> DataFrame:
    """Bill dictionary, one dictionary per line."""
    return bills_from_json(spark.read.text(path))


def write_table(df: DataFrame, *paths: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write to one or more places; for more than one the table is written once and copied on."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(paths[0])
    for path in paths[1:]:
        again = df.sparkSession.read.schema(df.schema).format(fmt)
        if fmt == "csv":
            again = again.options(header=True, multiLine=True, escape='"')
        write_table(again.load(paths[0]), path, fmt=fmt, mode=mode)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def read_matrix(spark: SparkSession, path: str, key: str, columns: Sequence[str], key_type: str = "string") -> DataFrame:
    """Wide matrix file to long form."""
    schema = ", ".join([f"`{key}` {key_type}"] + [f"`{c}` double" for c in columns])
    wide = read_table(spark, path, schema, line_breaks=False)
    named = F.array(*[F.struct(F.lit(c).alias("topic"), F.col(f"`{c}`").alias("score")) for c in columns])
    return wide.select(key, F.inline(named))


def cache_misses(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """One row per key that the cache does not hold: the smallest, where rows of a key differ."""
    missed = df.where(F.col(key).isNotNull()).join(cache, key, "left_anti")
    rest = [c for c in df.columns if c != key]
    if not rest:
        return missed.distinct()
    return missed.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(*df.columns)


def with_cache(
    df: DataFrame, cache: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Values by key from the cache, worked out by ``fn`` only for keys it misses.

    Gives the rows with their values and the rows to append to the cache. ``fn`` runs once: its
    rows are written before they are used for both.
    """
    fresh = cut_lineage(fn(cache_misses(df, cache, key)).select(*cache.columns))
    return df.join(cache.unionByName(fresh), key, "left"), fresh


def members_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Landed member records to a roster; other chambers and parties are left out."""
    m = F.from_json(F.col(col), MEMBER)
    terms = m["terms"]["item"]
    last: Column = F.get(terms, F.size(terms) - 1)
    return (
        df.select(
            "*",
            text.roster_lastname(m["name"]).alias("speaker"),
            text.map_codes(last["chamber"], fixed.CHAMBER_NAMES).alias("chamber"),
            text.map_codes(m["partyName"], fixed.PARTY_NAMES).alias("party"),
            m["state"].alias("state"),
        )
        .where(F.col("chamber").isNotNull() & F.col("party").isNotNull())
    )


def speaker_chamber(df: DataFrame, order: str) -> DataFrame:
    """First chamber of each speaker, read off two columns and the order."""
    return df.groupBy("speaker").agg(F.min_by("chamber", order).alias("chamber"))
