"""Cutting long documents into sentence-aligned chunks that overlap by one sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text

Counter = Callable[[Column], Column]


def needs_split(
    document: Column | str,
    target: Column | str,
    summary: Column | str,
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    max_input: int = fixed.MAX_INPUT_TOKENS,
    training: bool = False,
    counter: Counter = text.token_count,
) -> Column:
    """Too long for a scorer: by the whole input, or (not in training) by itself."""
    doc = F.col(document) if isinstance(document, str) else document
    too_long = text.combined_length(document, target, summary, counter) > max_input
    return too_long if training else too_long | (counter(doc) + 2 > max_tokens)


def _units(document: Column, max_tokens: int, counter: Counter) -> Column:
    """Sentences as units to pack; a sentence over the limit comes as its single words.

    kind 0: sentence, 1: word, 2: first word of a long sentence.
    """
    def unit(body: Column, kind: Column) -> Column:
        return F.struct(body.alias("body"), counter(body).alias("size"), kind.alias("kind"))

    def spread(s: Column) -> Column:
        pieces = F.transform(text.words(s["body"]), lambda w, i: unit(w, F.when(i == 0, 2).otherwise(1)))
        return F.when(s["size"] > max_tokens, pieces).otherwise(F.array(s))

    sized = F.transform(text.sentences(document), lambda s: unit(s, F.lit(0)))
    return F.flatten(F.transform(sized, spread))


def pack(
    document: Column,
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    counter: Counter = text.token_count,
) -> Column:
    """Chunks of one document as an array: greedy, each unit costing its tokens and a blank.

    A chunk that starts at a sentence repeats the sentence before when that fits the overlap.
    """
    empty = F.struct(
        F.array().cast("array<string>").alias("chunks"),
        F.lit("").alias("current"),
        F.lit(0).alias("size"),
        F.lit("").alias("last"),
        F.lit(0).alias("last_size"),
    )

    def step(acc: Column, u: Column) -> Column:
        fresh = (u["kind"] == 2) & (acc["current"] != "")
        chunks = F.when(fresh, F.concat(acc["chunks"], F.array(acc["current"]))).otherwise(acc["chunks"])
        current = F.when(fresh, F.lit("")).otherwise(acc["current"])
        size = F.when(u["kind"] == 2, F.lit(0)).otherwise(acc["size"])
        fits = size + u["size"] + 1 <= max_tokens
        sentence = u["kind"] == 0
        repeat = sentence & (acc["last"] != "") & (acc["last_size"] <= overlap) & F.lit(overlap > 0)

        joined = F.when(current == "", u["body"]).otherwise(F.concat_ws(" ", current, u["body"]))
        opened = F.when(repeat, F.concat_ws(" ", acc["last"], u["body"])).otherwise(u["body"])
        flushed = F.when(current != "", F.concat(chunks, F.array(current))).otherwise(chunks)
        restart = u["size"] + F.when(repeat, acc["last_size"] + 1).otherwise(F.lit(0))
        return F.struct(
            F.when(fits, chunks).otherwise(flushed).alias("chunks"),
            F.when(fits, joined).otherwise(opened).alias("current"),
            F.when(fits, size + u["size"] + 1).otherwise(restart).alias("size"),
            F.when(sentence, u["body"]).otherwise(acc["last"]).alias("last"),
            F.when(sentence, u["size"]).otherwise(acc["last_size"]).alias("last_size"),
        )

    def close(acc: Column) -> Column:
        return F.when(
            acc["current"] != "", F.concat(acc["chunks"], F.array(acc["current"]))
        ).otherwise(acc["chunks"])

    return F.aggregate(_units(document, max_tokens, counter), empty, step, close)


def split_documents(
    df: DataFrame,
    document: str = "document",
    target: str = "target",
    summary: str = "summary",
    max_tokens: int = fixed.MAX_CHUNK_TOKENS,
    overlap: int = fixed.OVERLAP_TOKENS,
    training: bool = False,
    counter: Counter = text.token_count,
) -> DataFrame:
    """One row per chunk, numbered from 1; short documents pass as one chunk.

    A document over the input limit but under its own limit stays whole.
    """
    doc = F.coalesce(F.col(document), F.lit(""))
    # A document within its own limit stays whole whatever its input adds up to, and one
    # beyond it is cut unless (in training) all of its input still fits.
    cut = counter(doc) + 2 > max_tokens
    if training:
        cut = cut & needs_split(document, target, summary, max_tokens, training=True, counter=counter)
    chunks = F.when(cut, pack(doc, max_tokens, overlap, counter)).otherwise(F.array(doc))
    return number_chunks(df.withColumn("_chunks", chunks), "_chunks", document)


def number_chunks(df: DataFrame, chunks: str, out: str) -> DataFrame:
    """Array of chunks to rows, with the number of the chunk and their total."""
    rest = [c for c in df.columns if c not in (chunks, out)]
    rows = df.select(
        *rest, F.size(chunks).alias("document_chunks_total"), F.posexplode(chunks).alias("_pos", out)
    )
    return rows.withColumn("document_chunk", F.col("_pos") + 1).drop("_pos")
