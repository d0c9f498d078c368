"""Prefix trie of conversations, counted on sorted matrices of turn ids.

Conversations become rows of turn ids. Rows are dealt out in ranges of their order, so a shard
holds a stretch of the sorted whole. A shard sorts its padded matrix with ``lexsort``; the
change of a column from one row to the next, or-ed over the columns before, marks where a node
starts at that depth, and ``reduceat`` over these starts adds up every depth. Nodes that reach
a shard's first or last row go on in the next shard and are put together afterwards.

Conversations longer than ``BLOCK`` turns are several rows, each named by the digest of the
turns before it, so the matrix has a bounded width. What lies below a block's end is added to
the blocks above by doubling steps over the block ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stage_path
from .shared import mixed, query, table

BLOCK = 32  # turns of a row
ROWS = 50_000  # rows of a shard
LENT = 6  # a conversation takes up to LENT - 1 turns of its group's first one
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)
KEY = pa.binary(16)

FINAL, ORPHAN, PART, PIECE, FIRST, LAST, BELOW = range(7)  # what a row of a shard's result is
FIELDS = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("col", pa.int32()),
    ("depth", pa.int64()), ("conv", pa.int64()), ("parent_conv", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()),
])
DDL = (
    "kind int, shard int, key binary, parent binary, col int, depth long, conv long, parent_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, chars long, ends string"
)


# Rows of turn ids ------------------------------------------------------------------------

def _next(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest of a prefix and one more turn, from the digest of the prefix and the turn's id."""
    x = mixed((high ^ a) * np.uint64(0xD6E8FEB86659FD93) + low)
    return x, mixed((low ^ b) * np.uint64(0xA0761D6478BD642F) + x)


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """16 bytes a row, in the order of the numbers."""
    return np.ascontiguousarray(np.stack([high, low], 1).astype(">u8")).view("V16")[:, 0]


def _after(start: bytes, ids: bytes) -> bytes:
    h = np.frombuffer(start, ">u8").astype(np.uint64)
    high, low = h[:1], h[1:]
    for pair in np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2):
        high, low = _next(high, low, pair[:1], pair[1:])
    return _packed(high, low).tobytes()


def _turns(df: DataFrame) -> DataFrame:
    """Turns with 128-bit ids in place of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = F.col("conv_id").cast("long")
    group = c - c % F.lit(100)
    return df.where(F.col("conv_id").isNotNull()).select(
        c.alias("conv"), group.alias("grp"), F.col("turn"), role.alias("role"), F.length(text).cast("long").alias("chars"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"),
        (F.crc32(c.cast("string").cast("binary")) % F.lit(LENT)).cast("int").alias("taken"),
    )


def rebuilt(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv, depth, more, key, chars`` of the rebuilt conversations, a row for each block of turns.

    A conversation starts with as many turns of its hundred's first one as its number's checksum
    says, and goes on with its own after as many. ``key`` is the digest of the turns before the
    block and the ids in it. The turns of a hundred conversations stream through a task, its
    first one ahead; memory stays that of a batch and a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = conv = None
        lent = lent_chars = b""
        start, depth, ids, chars, skip = ROOT, 0, b"", b"", 0
        out: list[tuple] = []

        def flushed(more: bool) -> None:
            nonlocal start, depth, ids, chars
            here, ids = ids[: 16 * block], ids[16 * block :]
            sizes, chars = chars[: 8 * block], chars[8 * block :]
            out.append((conv, depth, more, start + here, sizes))
            if more:
                start, depth = _after(start, here), depth + block

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pair = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b")], 1)
            raw = pair.view(np.uint64).astype(">u8").tobytes()
            sizes = batch.column("chars").to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            convs = batch.column("conv").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), n]
            groups, taken, convs = (batch.column("grp").to_pylist(), batch.column("taken").to_pylist(), convs.tolist())
            for i, j in zip(edges, edges[1:]):
                if convs[i] != conv or conv is None:
                    if conv is not None:
                        flushed(False)
                    if groups[i] != group or conv is None:
                        group, lent, lent_chars = groups[i], b"", b""
                    conv, start, depth, ids, chars, skip = convs[i], ROOT, 0, b"", b"", 0
                    if conv != group:
                        skip = taken[i]
                        ids, chars = lent[: 16 * skip], lent_chars[: 8 * skip]
                if conv == group and len(lent) < 16 * LENT:
                    lent, lent_chars = (lent + raw[16 * i : 16 * j])[: 16 * LENT], (lent_chars + sizes[8 * i : 8 * j])[: 8 * LENT]
                passed = min(skip, j - i)
                skip -= passed
                ids += raw[16 * (i + passed) : 16 * j]
                chars += sizes[8 * (i + passed) : 8 * j]
                while len(ids) > 16 * block:
                    flushed(True)
            if out:
                yield blocks(out)
                out.clear()
        if conv is not None:
            flushed(False)
            yield blocks(out)

    def blocks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["conv", "depth", "more", "key", "chars"])

    dealt = _turns(df).repartition("grp").sortWithinPartitions("grp", F.col("conv") != F.col("grp"), "conv", "turn", "role", "a", "b")
    return dealt.mapInArrow(run, "conv long, depth long, more boolean, key binary, chars binary")


# A shard -----------------------------------------------------------------------------------

def _codes(pairs: np.ndarray) -> np.ndarray:
    """Dense numbers from 1 for pairs, in their order."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    out = np.empty(len(pairs), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _rows(kind: int, shard: int, n: int, **columns) -> pa.RecordBatch:
    arrays = []
    for field in FIELDS:
        value = kind if field.name == "kind" else shard if field.name == "shard" else columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(n, field.type))
        elif isinstance(value, (int, str)):
            arrays.append(pa.repeat(pa.scalar(value, field.type), n))
        elif isinstance(value, np.ndarray) and value.dtype.kind == "V":
            arrays.append(pa.FixedSizeBinaryArray.from_buffers(KEY, n, [None, pa.py_buffer(value.tobytes())]).cast(pa.binary()))
        else:
            arrays.append(pa.array(value, field.type))
    return pa.record_batch(arrays, schema=FIELDS)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = TaskContext.get().partitionId()
    rows = pa.Table.from_batches(held)
    keys = rows.column("key").to_pylist()
    conv = rows.column("conv").to_numpy()
    base = rows.column("depth").to_numpy()
    more = rows.column("more").to_numpy()
    n = len(keys)
    counts = np.array([len(k) // 16 - 1 for k in keys])
    width = int(counts.max())
    pairs = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
    places = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    starts = pairs[places]
    inner = np.ones(len(pairs), bool)
    inner[places] = False
    filled = np.arange(width) < counts[:, None]
    matrix = np.zeros((n, width + 1), np.int64)  # column 0 names the block, then turns, then padding
    matrix[:, 0] = _codes(starts)
    matrix[:, 1:][filled] = _codes(pairs[inner]) if inner.any() else 0
    ids = np.zeros((n, width, 2), np.uint64)
    ids[filled] = pairs[inner]
    chars = np.zeros((n, width + 1), np.int64)
    chars[:, 1:][filled] = np.frombuffer(b"".join(rows.column("chars").to_pylist()), "<i8")

    order = np.lexsort((conv, more, *matrix.T[::-1]))
    matrix, ids, chars, starts = matrix[order], ids[order], chars[order], starts[order]
    conv, base, more, counts = conv[order], base[order], more[order], counts[order]
    fresh = np.ones((n, width + 2), bool)  # a node starts in this row at this depth
    fresh[1:, :-1] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    there = np.zeros((n, width + 2), bool)
    there[:, :-1] = np.arange(width + 1) <= counts[:, None]
    saved = np.where(there[:, :-1] & ~fresh[:, :-1], chars, 0)[:, ::-1].cumsum(axis=1)[:, ::-1]
    leaf = np.zeros(n, np.int64)  # the last row of a childless node
    leaf[:-1] = fresh[np.arange(1, n), counts[:-1]] & ~more[:-1]

    names = list(map(str, conv.tolist()))
    full = np.flatnonzero(fresh[:, width])  # rows alike in all columns, those that end here first
    ended = np.add.reduceat(~more, full)
    high, low = starts[:, 0].copy(), starts[:, 1].copy()
    path = [_packed(high, low)]
    above_conv = above_part = above_key = None
    above = np.zeros(n, np.int64)
    for j in range(width + 1):
        if j:
            high, low = _next(high, low, ids[:, j - 1, 0], ids[:, j - 1, 1])
            path.append(_packed(high, low))
        at = np.flatnonzero(fresh[:, j])
        sizes = np.diff(np.append(at, n))
        segment = np.cumsum(fresh[:, j]) - 1
        least = np.minimum.reduceat(conv, at)
        part = np.maximum.reduceat(more, at) | (at == 0) | (at + sizes == n) | (j == 0)
        real = there[at, j]
        ends = np.full(len(at), EMPTY, object)
        pieces = []
        for i in np.flatnonzero((counts[full] == j) & (ended > 0)).tolist():
            said = ",".join(names[full[i] : full[i] + ended[i]])
            if part[segment[full[i]]]:
                pieces.append((full[i], said))
            else:
                ends[segment[full[i]]] = hashlib.sha256(said.encode()).hexdigest()
        if pieces:
            where = np.array([p for p, _ in pieces])
            yield _rows(PIECE, shard, len(where), key=path[j][where], conv=conv[where], ends=[s for _, s in pieces])
        facts = {
            "key": path[j][at], "depth": base[at] + j, "conv": least, "n_convs": sizes,
            "n_children": np.add.reduceat((fresh[:, j + 1] & there[:, j + 1]).astype(np.int64), at),
            "n_leaves": np.add.reduceat(leaf, at), "saved": np.add.reduceat(saved[:, j], at), "ends": ends,
        }
        if j:
            facts |= {"parent": above_key[above[at]], "parent_conv": above_conv[above[at]]}
        else:
            facts["n_convs"] = np.where(base[at] > 0, 0, sizes)  # counted at the end of the block before
        whole = real & ~part
        lost = above_part[above[at]] if j else np.ones(len(at), bool)
        for kind, chosen, leave in (
            (FINAL, whole & ~lost, ("key", "parent")), (ORPHAN, whole & lost, ("key", "parent_conv")), (PART, real & part, ("parent_conv", "ends")),
        ):
            if chosen.any():
                yield _rows(kind, shard, int(chosen.sum()), col=j, **{k: v[chosen] for k, v in facts.items() if k not in leave})
        above, above_conv, above_part, above_key = segment, least, part, facts["key"]

    for kind, row in ((FIRST, 0), (LAST, n - 1)):
        deep = int(counts[row])
        yield _rows(
            kind, shard, deep + 1, key=np.array([path[j][row] for j in range(deep + 1)], "V16"), col=np.arange(deep + 1),
            chars=chars[row, : deep + 1].cumsum(), n_leaves=int(not more[row]), depth=deep,
        )
    go_on = full[np.maximum.reduceat(more, full)]
    if len(go_on):
        for j in range(width):  # rows that go on are full
            yield _rows(BELOW, shard, len(go_on), key=path[width][go_on], parent=path[j][go_on], col=j)


# Putting shards together ---------------------------------------------------------------------

def _stored(df: DataFrame, name: str) -> DataFrame:
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _corrections(found: DataFrame) -> DataFrame:
    """What shards took for new at their first row, and could not see after their last.

    A shard starts all nodes on its first row's path anew. Those that an earlier shard has too
    form the top of that path; their text was not counted as saved and they were counted as
    children once too often. The node of the last row has no children when no later shard has it.
    """
    top = F.col("col") == 0
    spans = found.where(F.col("kind") == PART).groupBy("key", top.alias("top")).agg(F.min("shard").alias("_from"), F.max("shard").alias("_to"))

    def path(kind: int) -> DataFrame:
        rows = found.where(F.col("kind") == kind).select("shard", "key", "col", "chars", "n_leaves", "depth", top.alias("top"))
        return rows.join(spans, ["key", "top"])

    first = path(FIRST).where(F.col("shard") > F.col("_from"))
    before = F.coalesce(F.lag("chars").over(Window.partitionBy("shard").orderBy("col")), F.lit(0))
    reach = first.groupBy("shard").agg(F.max("col").alias("_deep"), F.max("chars").alias("_chars"))
    shared = first.select("shard", "key", "col", "chars", "top", before.alias("_before")).join(reach, "shard")
    texts = shared.select(
        "key", "top", (F.col("_chars") - F.col("_before")).alias("saved"),
        F.when(F.col("col") < F.col("_deep"), -1).otherwise(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"),
    )
    last = path(LAST)
    ends = last.where((F.col("col") == F.col("depth")) & (F.col("n_leaves") == 1) & (F.col("_to") == F.col("shard"))).select("shard")
    zero = F.lit(0).cast("long")
    leaves = last.join(ends, "shard").select("key", "top", zero.alias("saved"), zero.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"))
    return texts.union(leaves)


def _below(parts: DataFrame, below: DataFrame) -> DataFrame:
    """Sums of the blocks under each block end, by doubling: ``key, n_leaves, saved``."""
    own = parts.where("top").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    up = below.where("col = 0").select("key", F.nullif(F.col("parent"), F.lit(ROOT)).alias("up"))
    now = _stored(up.join(own, "key"), "below")
    while now.where("up IS NOT NULL").limit(1).count():
        given = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s")).withColumnRenamed("up", "key")
        higher = now.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        now = _stored(
            now.join(given, "key", "left").join(higher, "up", "left").select(
                "key", F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"),
            ),
            "below",
        )
    return now.select("key", "n_leaves", "saved")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's pieces in order, read one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = said = None
        done: list[tuple] = []
        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, said.hexdigest()))
                    now, said = key, hashlib.sha256(ends.encode())
                else:
                    said.update(b"," + ends.encode())
            if done:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), (pa.binary(), pa.string()))], ["key", "ends"])
                done = []
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([said.hexdigest()])], ["key", "ends"])

    dealt = pieces.select("key", "conv", "ends").repartition("key").sortWithinPartitions("key", "conv")
    return dealt.select("key", "ends").mapInArrow(run, "key binary, ends string")


def prefix_trie(df: DataFrame, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, one row for each.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Turns are ordered by turn (null first), then role, then a digest of role and text. A null
    role or text counts as empty, repeated rows are repeated turns, rows without ``conv_id`` are
    no conversation, a conversation left without turns belongs to the root alone, an empty table
    gives an empty result, other columns are ignored. ``conv_id % 100`` has the sign of
    ``conv_id``. ``rows`` bounds what a shard holds, ``block`` the turns of a row; equal conversations are dealt over shards by
    ``conv_id``, so it holds for them too. Turns are compared by 128-bit hashes.
    """
    spark = df.sparkSession
    blocks = _stored(rebuilt(df, block), "blocks")
    shards = max(-(-blocks.count() // rows), spark.sparkContext.defaultParallelism)
    found = _stored(blocks.repartitionByRange(shards, "key", "more", "conv").mapInArrow(_shard, DDL), "shards")

    top = (F.col("col") == 0).alias("top")
    sums = ["n_children", "n_leaves", "saved"]
    own = found.where(F.col("kind") == PART).select("key", top, "parent", "depth", "conv", "n_convs", *sums)
    fixed = _corrections(found).select(
        "key", "top", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("conv"), F.lit(0).cast("long").alias("n_convs"), *sums,
    )
    parts = _stored(own.unionByName(fixed), "parts")
    below = found.where(F.col("kind") == BELOW).select("key", "parent", "col").distinct()
    if found.where(F.col("kind") == BELOW).limit(1).count():
        deep = below.join(_below(parts, below), "key").select(
            F.col("parent").alias("key"), F.lit(False).alias("top"), F.lit(None).cast("binary").alias("parent"),
            F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv"), F.lit(0).cast("long").alias("n_convs"),
            F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved",
        )
        parts = parts.unionByName(deep)
    merged = parts.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"),
        *[F.sum(c).alias(c) for c in sums],
    )
    whole = _stored(
        merged.join(_digests(found.where(F.col("kind") == PIECE)), "key", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))), "nodes"
    )
    orphans = found.where(F.col("kind") == ORPHAN).select("parent", "depth", "conv", "n_convs", *sums, "ends")
    young = orphans.unionByName(whole.select(*orphans.columns))
    parents = whole.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    nodes = young.join(parents, "parent", "left").drop("parent").unionByName(
        found.where(F.col("kind") == FINAL).select("depth", "conv", "n_convs", *sums, "ends", "parent_conv")
    )
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


@query(
    f"""WITH bits AS (SELECT range AS n FROM range(256)),
    crc_table AS (SELECT list(c ORDER BY n) AS ct FROM (
      SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM bits)),
    own AS (
      SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    checked AS (
      SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
        lambda x, y: xor(ct[xor(x & 255, y) + 1], x >> 8)), 4294967295) % {LENT} AS h FROM own, crc_table),
    built AS MATERIALIZED (
      SELECT o.c, CASE WHEN o.c % 100 = 0 THEN o.l ELSE list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) END AS l
      FROM checked AS o LEFT JOIN own AS b ON b.c = o.c - o.c % 100),
    nodes AS MATERIALIZED (
      SELECT d, p, min(c) AS conv, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends
      FROM (SELECT c, len(l) AS size, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)) GROUP BY d, p),
    tied AS MATERIALIZED (SELECT d, p, p[1:d - 1] AS up, conv, n, ends FROM nodes),
    children AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM tied WHERE d > 0 GROUP BY ALL),
    counted AS MATERIALIZED (SELECT t.*, coalesce(k, 0) AS k FROM tied AS t LEFT JOIN children AS c ON c.d = t.d AND c.p = t.p),
    under AS (
      SELECT a AS d, p[1:a] AS p, CAST(count(*) FILTER (k = 0) AS BIGINT) AS leaves, CAST(sum((n - 1) * CASE WHEN d > 0 THEN length(p[d].x) ELSE 0 END) AS BIGINT) AS saved
      FROM (SELECT d, p, n, k, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL)
    SELECT t.conv AS conv_id, t.d AS depth, u.conv AS parent_conv_id, t.n AS n_convs, t.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, t.ends AS ends_sha256
    FROM counted AS t JOIN under AS s ON s.d = t.d AND s.p = t.p LEFT JOIN tied AS u ON u.d = t.d - 1 AND u.p = t.up"""
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
