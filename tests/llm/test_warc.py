import gzip
import hashlib

from pyspark.sql import functions as F

from hustings.llm import warc
from hustings.session import stage_path


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        again = to is not None and i != to
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_odd_pages(spark):
    long = "näv <p>" * 200_000
    rows = [
        (3, "http://a", "x" * 100), (1, "http://b\r\nc", "x" * 100), (2, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
        (7, "ü", long), (8, "u", long), (8, "u", long), (1, "u", "x" * 100), (None, "u", "x" * 100), (None, "u", "alone " * 30),
        (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folder = stage_path(spark, "warc-test")
    manifest = warc.archived(df.repartition(2), folder)
    assert sorted(map(tuple, warc.payload_table(manifest).collect()), key=str) == expected(rows)
    whole = warc.read_archives(manifest, chunk=1000).orderBy("file", "record_no", "chunk_no").collect()
    assert max(len(r.data) for r in whole) <= 1000
    held = {}
    for r in whole:
        held.setdefault((r.file, r.record_no), []).append(r)
    for v in held.values():
        data = b"".join(c.data for c in v)
        assert v[-1].is_last and v[-1].digest_so_far == hashlib.sha256(data).hexdigest()
        if v[0].record_type == "response":
            assert v[-1].digest_so_far == v[0].declared_digest and v[-1].bytes_so_far == len(data)
    for r in manifest.collect():
        raw = gzip.open(r.file.removeprefix("file:"), "rb").read()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_empty_table_and_small_files(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.payload_table(warc.archived(empty, stage_path(spark, "warc-test"))).count() == 0
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 50).alias("html"))
    files = warc.write_archives(warc.chunked(warc.records(df.coalesce(1)), 300), stage_path(spark, "warc-test"), file_bytes=5000).collect()
    assert len(files) > 3 and sum(f.records for f in files) == 50
