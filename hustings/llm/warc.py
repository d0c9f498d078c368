"""WARC archives written and read as tables of record chunks, payloads never whole in memory."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage_path
from .shared import pieces, query, table

CHUNK = 1 << 18
FILE_BYTES = 1 << 30
LEAST_SHARED = 100
GZIP_LEVEL = 4


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``key, url, payload binary, length, digest, first`` of every page.

    Of equal payloads of at least 100 bytes the smallest key is ``first``; ``first`` is null for
    shorter ones and where no row has a key. Equal payloads are brought together by digest, counted
    before the shuffle, so copies cost a row per task there; the join after it is cut up by
    Spark where one digest has too many rows.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"),
    )
    firsts = rows.where(F.col("length") >= LEAST_SHARED).groupBy("digest").agg(F.min("key").alias("first"))
    return rows.join(firsts, "digest", "left")


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Record table to chunk rows: ``record_id, chunk_no, data`` beside the header fields.

    Chunks of a record follow each other in their partition. A revisit has one empty chunk.
    """
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.md5(F.concat_ws("|", c.cast("string"), F.col("digest")))
    last = F.when(revisit, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("length") / chunk) - 1)).cast("int")
    heads = rows.withColumn("record_id", name(F.col("key"))).withColumn("refers_to", F.when(revisit, name(F.col("first"))))
    each = heads.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return each.select(
        "key", "url", "length", "digest", "record_id", "refers_to", "chunk_no",
        F.when(F.col("refers_to").isNull(), part).otherwise(F.lit(b"")).alias("data"),
    )


def _urn(digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(digest)}>"


def _header(key: object, url: str | None, length: int, digest: str, name: str, refers: str | None, date: str) -> bytes:
    """WARC header, and for a response the HTTP header that its block begins with."""
    http = b""
    if refers is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": _urn(name),
        "WARC-Date": date,
        "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": refers and _urn(refers),
        "WARC-Profile": refers and "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-ID": None if key is None else str(key),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + length if refers is None else 0),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + http


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Chunk rows to gzipped archives in ``folder``; gives the manifest ``file, records, bytes``.

    Each record is a gzip member, written chunk by chunk. Every attempt of a task writes files
    of its own, and only the manifest of the attempt that Spark commits names them, so tasks
    may fail or run twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        done, out, packer, n, size = [], None, None, 0, 0

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        def close_record() -> None:
            nonlocal packer
            if packer:
                put(packer.compress(b"\r\n\r\n"))
                put(packer.flush())
                packer = None

        def close_file() -> None:
            nonlocal out, n, size
            if out:
                out.close()
                done.append((name, n, size))
                out, n, size = None, 0, 0

        for batch in pieces(batches, "data"):
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    close_record()
                    if size >= file_bytes:
                        close_file()
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    n += 1
                    head = (row[c] for c in ("key", "url", "length", "digest", "record_id", "refers_to"))
                    put(packer.compress(_header(*head, date)))
                put(packer.compress(row["data"]))
        close_record()
        close_file()
        yield pa.record_batch(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))],
            ["file", "records", "bytes"],
        )

    return chunks.mapInArrow(run, "file string, records long, bytes long")


def _inflated(stream: pa.NativeFile, block: int) -> Iterator[bytes]:
    """Bytes of a file of gzip members, at most ``block`` at a time."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(block):
        more = True
        while data or more:
            out = unpack.decompress(data, block)
            if out:
                yield out
            more = len(out) == block
            if unpack.eof:
                data, unpack, more = unpack.unused_data, zlib.decompressobj(31), False
            else:
                data = unpack.unconsumed_tail


class _Bytes:
    """Reads up to a mark, or a number of bytes in parts."""

    def __init__(self, source: Iterator[bytes]) -> None:
        self.source, self.held = source, b""

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            more = next(self.source, None)
            if more is None:
                return None
            self.held += more
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def parts(self, n: int, most: int) -> Iterator[bytes]:
        while n:
            while len(self.held) < min(n, most):
                self.held += next(self.source)
            part, self.held = self.held[: min(n, most)], self.held[min(n, most) :]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


CHUNKS = (
    "file string, record_no long, record_type string, record_id string, refers_to string, page string, url string, "
    "declared_digest string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, is_last boolean"
)
_CHUNK_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
_CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True, per_batch: int = 64) -> DataFrame:
    """Chunk rows of the archives a manifest names, as ``CHUNKS``.

    Each row carries the bytes and the SHA-256 of the payload so far; the row with ``is_last``
    has those of the whole payload. ``payloads=False`` leaves ``data`` null, and then gives the
    last row of each record alone. A file is read in one task, block by block.
    """

    def rows_of(path: str) -> Iterator[tuple]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at, compression=None) as stream:
            source, no = _Bytes(_inflated(stream, chunk)), -1
            while (head := source.until(b"\r\n\r\n")) is not None:
                no += 1
                f = _fields(head)
                left = int(f["Content-Length"])
                if f["WARC-Type"] == "response":
                    left -= len(source.until(b"\r\n\r\n")) + 4
                said = (
                    path, no, f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("X-Page-ID"),
                    f.get("WARC-Target-URI"), f["WARC-Payload-Digest"].removeprefix("sha256:"),
                )
                so_far, n, k = hashlib.sha256(), 0, 0
                if not left:
                    yield (*said, 0, b"" if payloads else None, 0, so_far.hexdigest(), True)
                for part in source.parts(left, chunk):
                    so_far.update(part)
                    n += len(part)
                    if payloads or n == left:
                        yield (*said, k, part if payloads else None, n, so_far.hexdigest(), n == left)
                    k += 1
                source.until(b"\r\n\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path in batch.column("file").to_pylist():
                for row in rows_of(path):
                    held.append(row)
                    if len(held) >= per_batch * (1 if payloads else 100):
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), _CHUNK_TYPES)], _CHUNK_NAMES)
                        held = []
        if held:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), _CHUNK_TYPES)], _CHUNK_NAMES)

    return manifest.select("file").mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Pages written to archives in ``folder``; gives the manifest as a written table there."""
    spark = pages.sparkSession
    write_archives(chunked(records(pages)), f"{folder}/data").write.parquet(f"{folder}/manifest")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")


def payload_table(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every archived record.

    A revisit has the length and digest of the response it refers to, found by record id. Null
    payloads are empty; a null page id stays null; repeated rows are archived repeatedly, and
    rows that share id and payload are all responses; an empty table gives no rows.
    """
    found = read_archives(manifest, payloads=False).select(
        F.col("page").cast("long").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", "record_id", F.col("refers_to").alias("_to"),
    )
    spark = manifest.sparkSession
    path = stage_path(spark, "warc-records")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    responses = found.where(F.col("record_type") == "response")
    first = responses.groupBy(F.col("record_id").alias("_to")).agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest")
    )
    again = found.where(F.col("record_type") == "revisit").join(first, "_to").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(again)


@query(
    """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                         sha256(coalesce(html, '')) AS payload_digest FROM pages),
       f AS (SELECT *, CASE WHEN payload_bytes >= 100
                            THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first FROM p)
       SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived in the shared folder and read back from there."""
    return payload_table(archived(table(spark, sf_dir, "pages"), stage_path(spark, "warc")))
