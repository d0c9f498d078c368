"""Byte-level BPE: merges from a priority queue over a linked list of symbols, and back to text."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import pieces, query, table

# The split of byte-level BPE vocabularies of this kind, from their public definition.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHE_WORDS = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict.fromkeys(plain)
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file.

    ``encode`` gives the ids of a text: added tokens stand for themselves, the rest is split
    into words, and each word is merged by rank. Words met before are kept in two generations
    of at most ``CACHE_WORDS`` each, so memory stays bounded whatever the corpus.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [vocab[c] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes_of = {
            **{i: bytes(back[c] for c in t) for t, i in vocab.items()},
            **{i: t.encode() for t, i in added.items()},
        }
        self.added = added
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(SPLIT)
        self.new: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word. The queue holds (rank, place, left id, right id, merged id); an entry
        whose symbols have changed since it was pushed is stale and skipped."""
        ids = [self.first[b] for b in word.encode()]
        n = len(ids)
        if n == 1:
            return ids
        ranks = self.ranks
        queue = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, left, right, both = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = both, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if found := ranks.get((both, ids[j])):
                    heapq.heappush(queue, (found[0], i, both, ids[j], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], both))):
                heapq.heappush(queue, (found[0], h, ids[h], both, found[1]))
        return [x for x in ids if x >= 0]

    def _fresh(self, word: str) -> list[int]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.merge(word)
        if len(word) <= 64:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for word in self.words.findall(part):
                out += self.new.get(word) or self._fresh(word)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker, with its cache kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>, decoded string`` of every row; a null text counts as empty.

    Rows stay where they are: no shuffle, and each batch is bounded by the bytes of its texts.
    An empty text has no ids and decodes to an empty text. Repeated rows come out repeated;
    a null key stays null; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in pieces(batches, "text"):
            ids, back = [], []
            for t in batch.column("text").to_pylist():
                found = c.encode(t or "")
                ids.append(found)
                back.append(c.decode(found))
            yield pa.record_batch(
                [batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["key", "ids", "decoded"]
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def token_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row, as ``encode_texts`` gives them.

    The digests are taken where the ids are, so neither ids nor texts leave the task.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        shown = {i: str(i) for i in c.bytes_of}
        for batch in pieces(batches, "text"):
            n, ids_digest, text_digest = [], [], []
            for t in batch.column("text").to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                text_digest.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: token count and digests of ids and text."""
    return token_digests(table(spark, sf_dir, "documents"), default_vocabulary())
