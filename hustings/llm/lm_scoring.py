"""Stupid-backoff scores of documents under the word pairs of all other documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage_path
from .shared import mixed, pieces, query, table

BACKOFF = 0.4
BLOCK_CHARS = 8_000_000
WORDS_KEPT = 500_000
GRAMS_KEPT = 1 << 20
MICRO = 1_000_000  # scores are added up in whole millionths, in any order to the same sum

_UNKNOWN, _BEGIN, _END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" unknown", b" begin", b" end"))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)
_WORD, _PAIR = 0, 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Totals(NamedTuple):
    """Documents, words and unknown words of the corpus; documents that make a word known."""

    docs: int
    tokens: int
    unknown: int
    least: float


def _split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane, so that high bytes that are zero cost nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


BLOCK = "block long, n_docs long, n_tokens long, n_words long, ids binary, lengths binary, tokens binary, words binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, lengths, and their words as places in the block's own list of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        block = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", BLOCK_CHARS):
            if len(hashes) > WORDS_KEPT:
                hashes.clear()
            of, lengths = [], []
            for t in batch.column("text").to_pylist():
                words = _split(t)
                for w in words:
                    if w not in hashes:
                        hashes[w] = xxhash.xxh3_64_intdigest(w)
                of.append(np.fromiter((hashes[w] for w in words), np.uint64, len(words)))
                lengths.append(len(words))
            own, tokens = np.unique(np.concatenate(of), return_inverse=True)
            ids = batch.column("id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            row = (
                block, len(ids), len(tokens), len(own), _packed(np.diff(ids, prepend=np.int64(0))), _packed(np.array(lengths, np.uint32)),
                _packed(tokens.astype(np.uint32)), _packed(np.diff(own, prepend=np.uint64(0))),
            )
            block += 1
            yield pa.record_batch([*(pa.array([x], pa.int64()) for x in row[:4]), *(pa.array([x], pa.binary()) for x in row[4:])], [c.split()[0] for c in BLOCK.split(", ")])

    return docs.mapInArrow(run, BLOCK)


class Block:
    """A block's documents, and for each word how often and in how many of them it is."""

    def __init__(self, row: dict) -> None:
        self.block, self.n_docs = row["block"], row["n_docs"]
        self.ids = np.cumsum(_unpacked(row["ids"], np.int64, row["n_docs"]))
        self.lengths = _unpacked(row["lengths"], np.uint32, row["n_docs"]).astype(np.int64)
        self.tokens = _unpacked(row["tokens"], np.uint32, row["n_tokens"]).astype(np.int64)
        self.words = np.cumsum(_unpacked(row["words"], np.uint64, row["n_words"]))
        n = row["n_words"]
        self.n = np.bincount(self.tokens, minlength=n)
        owner = np.repeat(np.arange(self.n_docs), self.lengths)
        self.docs = np.bincount(np.unique(owner * n + self.tokens) % max(1, n), minlength=n)

    def know(self, n: np.ndarray, docs: np.ndarray, totals: Totals) -> None:
        """Word pairs of the documents, once it is there what other blocks have of each word."""
        count, known = self.n + n, self.docs + docs >= totals.least
        hashes = np.concatenate([np.where(known, self.words, _UNKNOWN), np.array([_BEGIN, _END])])
        counts = np.concatenate([np.where(known, count, totals.unknown), [totals.docs, totals.docs]])
        ends = np.cumsum(self.lengths + 2)
        run = np.empty(int(ends[-1]), np.int64)
        inner = np.ones(len(run), bool)
        inner[ends - 1] = inner[ends - self.lengths - 2] = False
        run[ends - self.lengths - 2], run[ends - 1], run[inner] = len(hashes) - 2, len(hashes) - 1, self.tokens
        first = np.ones(len(run), bool)
        first[ends - 1] = False
        at = np.flatnonzero(first)
        left, right = run[at], run[at + 1]
        pair = mixed(mixed(hashes[left]) * _STEP + hashes[right])
        self.pairs, start, place = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_n = np.bincount(place)
        self.left, self.right = counts[left[start]], counts[right[start]]
        owner = np.repeat(np.arange(self.n_docs), self.lengths + 1)
        own, self.times = np.unique(owner * len(self.pairs) + place, return_counts=True)
        self.owner, self.pair = own // len(self.pairs), own % len(self.pairs)


GRAMS = "block long, bucket long, n long, hashes binary, counts binary, docs binary"
COUNTS = "block long, kind int, bucket long, n long, counts binary, docs binary, rare long"


def _grams(block: int, hashes: np.ndarray, counts: np.ndarray, docs: np.ndarray, buckets: int) -> pa.Table:
    """A row per bucket of hashes: what a block has there, in the order of the hashes."""
    edges = np.array([min((b << 64) // buckets, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
    filled = np.flatnonzero(np.diff(cuts))
    parts = [slice(cuts[b], cuts[b + 1]) for b in filled]
    return pa.table({
        "block": np.full(len(filled), block), "bucket": filled.astype(np.int64), "n": np.diff(cuts)[filled].astype(np.int64),
        "hashes": pa.array([_packed(np.diff(hashes[x], prepend=np.uint64(0))) for x in parts], pa.binary()),
        "counts": pa.array([_packed(counts[x].astype(np.int64)) for x in parts], pa.binary()),
        "docs": pa.array([_packed(docs[x].astype(np.int64)) for x in parts], pa.binary()),
    })


def _elsewhere(grams: DataFrame, kind: int, least: float) -> DataFrame:
    """The count table of each bucket, joined to the blocks' rows: what the other blocks have of each gram.

    ``rare`` is how often the row has grams that fewer than ``least`` documents have.
    """

    def count(rows: pa.Table) -> pa.Table:
        ns = rows["n"].to_numpy()
        column = lambda c, kind: [_unpacked(x, kind, n) for x, n in zip(rows[c].to_pylist(), ns)]
        _, gram = np.unique(np.concatenate([np.cumsum(x) for x in column("hashes", np.uint64)]), return_inverse=True)
        own = {c: np.concatenate(column(c, np.int64)) for c in ("counts", "docs")}
        total = {}
        for c, x in own.items():
            total[c] = np.zeros(int(gram.max()) + 1, np.int64)
            np.add.at(total[c], gram, x)
        starts = np.concatenate([[0], np.cumsum(ns)])
        rare = np.concatenate([[0], np.cumsum(np.where(total["docs"][gram] < least, own["counts"], 0))])
        out = {"block": rows["block"], "kind": np.full(len(ns), kind, np.int32), "bucket": rows["bucket"], "n": rows["n"]}
        for c, x in own.items():
            others = total[c][gram] - x
            out[c] = pa.array([_packed(others[i:j]) for i, j in zip(starts, starts[1:])], pa.binary())
        return pa.table({**out, "rare": rare[starts[1:]] - rare[starts[:-1]]})

    return grams.groupBy("bucket").applyInArrow(count, COUNTS)


def _each(rows: DataFrame, counted: DataFrame, totals: Totals, run, schema: str) -> DataFrame:
    """``run`` on each block and what other blocks have of its words and pairs, which goes to it by block."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0])
        found = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        column = lambda c, kind: np.concatenate(
            [np.empty(0, np.int64), *(_unpacked(r[c], np.int64, r["n"]) for r in found if r["kind"] == kind)]
        )
        b.know(column("counts", _WORD), column("docs", _WORD), totals)
        return run(b, column("counts", _PAIR))

    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(group, schema)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job go when the table it writes is there."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def score(docs: DataFrame, share: float = 0.0, backoff: float = BACKOFF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_seen, log_score, mean_log_score`` of every document.

    Each word, and the end of the document, is scored after the word before it: by how often
    other documents have the pair, over how often the corpus has the first word; where no other
    document has the pair, by ``backoff`` times the share of the second word. Counts are over
    all documents and all words. A word of one document alone, which no other can know, counts
    as unknown whatever the size of the corpus; so does one below ``share`` of the documents.

    Words and pairs are counted by 64-bit hash, first within blocks of documents. What the blocks
    have is dealt to ranges of the hash, as many as keep ``GRAMS_KEPT`` entries in each on
    average; a range is a count table, to which the blocks' grams are joined, and what other
    blocks have of them goes back by block. Even the commonest pair has one entry a block. The
    shuffle files of a step go when its table is written.

    A text without words, or a null text, has the end alone to score. Rows that share an id are
    added up as one document, but count as others to each other; so do rows without an id. Other
    columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = stage_path(spark, name)
        with _shuffles_removed(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = staged(_blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))), "lm-blocks")
    corpus = rows.agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_words")]).first()
    n_docs, n_tokens, n_words = (corpus[c] or 0 for c in ("n_docs", "n_tokens", "n_words"))
    least = max(2.0, share * n_docs)
    word_buckets, pair_buckets = (1 + n // GRAMS_KEPT for n in (n_words, n_tokens + n_docs))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                yield from _grams(b.block, b.words, b.n, b.docs, word_buckets).to_batches()

    known = staged(_elsewhere(rows.mapInArrow(words, GRAMS), _WORD, least), "lm-words")
    totals = Totals(n_docs, n_tokens + n_docs, known.agg(F.sum("rare")).first()[0] or 0, least)

    def pairs(b: Block, _: np.ndarray) -> pa.Table:
        return _grams(b.block, b.pairs, b.pair_n, np.zeros(len(b.pairs), np.int64), pair_buckets)

    shared = staged(_elsewhere(_each(rows, known, totals, pairs, GRAMS), _PAIR, 0.0), "lm-pairs")

    def scores(b: Block, elsewhere: np.ndarray) -> pa.Table:
        total = b.pair_n + elsewhere
        others = total[b.pair] - b.times
        missing = np.log(backoff * np.maximum(b.right, 1) / max(1, totals.tokens))
        value = np.where(others > 0, np.log(np.maximum(others, 1)) - np.log(np.maximum(b.left, 1))[b.pair], missing[b.pair])
        sums = np.zeros((3, b.n_docs), np.int64)
        np.add.at(sums[0], b.owner, np.rint(value * MICRO).astype(np.int64) * b.times)
        np.add.at(sums[1], b.owner, b.times)
        np.add.at(sums[2], b.owner, np.where(others > 0, b.times, 0))
        return pa.table({"id": pa.array(b.ids, mask=b.ids == _NO_ID), "micro": sums[0], "n": sums[1], "seen": sums[2]})

    parts = _each(rows, known.unionByName(shared), totals, scores, "id long, micro long, n long, seen long")
    sums = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("micro", "n", "seen")])
    total = F.col("micro") / F.lit(float(MICRO))
    return sums.select(
        F.col("id").alias(key), F.col("n").alias("n_tokens"), F.col("seen").alias("n_seen"), total.alias("log_score"), (total / F.col("n")).alias("mean_log_score")
    )


@query(
    rf"""WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    v AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT rid) >= 2),
    r AS (SELECT rid, i, CASE WHEN v.word IS NULL THEN 'unknown' ELSE '=' || v.word END AS s FROM w LEFT JOIN v USING (word)
          UNION ALL SELECT rid, 0, 'begin' FROM d UNION ALL SELECT rid, len(ws) + 1, 'end' FROM d),
    p AS (SELECT rid, s AS a, lead(s) OVER (PARTITION BY rid ORDER BY i) AS b FROM r),
    own AS (SELECT rid, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
    whole AS (SELECT a, b, sum(n) AS c FROM own GROUP BY ALL),
    one AS (SELECT s, count(*) AS c FROM r GROUP BY s),
    x AS (SELECT rid, n, whole.c - n AS others, ca.c AS ca, cb.c AS cb,
                 (SELECT count(*) FROM p WHERE b IS NOT NULL) AS tokens
          FROM own JOIN whole USING (a, b) JOIN one ca ON ca.s = a JOIN one cb ON cb.s = b),
    y AS (SELECT rid, n, CASE WHEN others > 0 THEN n ELSE 0 END AS seen,
                 n * CAST(round_even((CASE WHEN others > 0 THEN ln(others) - ln(ca) ELSE ln({BACKOFF}::DOUBLE * cb / tokens) END) * {MICRO}, 0) AS BIGINT) AS micro
          FROM x)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(seen) AS BIGINT) AS n_seen,
           CAST(sum(micro) AS BIGINT) / {MICRO}.0::DOUBLE AS log_score,
           CAST(sum(micro) AS BIGINT) / {MICRO}.0::DOUBLE / CAST(sum(n) AS BIGINT) AS mean_log_score
    FROM y JOIN d USING (rid) GROUP BY rid, doc_id"""
)
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the pair counts of all others."""
    return score(table(spark, sf_dir, "documents"))
