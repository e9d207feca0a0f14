"""WARC archives: written in parts that don't depend on how tasks ran, and read back.

Records are range-sorted by page and payload digest. Where ranges end follows from the
payloads' sizes alone (`ranges`; a page that has too much for one is cut by digest), so that
the same pages give the same files and manifest. Each range is written by one task into gzip
files, one member for a record, a new file when one has reached its compressed size. Files are
written under temporary names that hold the attempt; what a task has written becomes a
row of the manifest only if the task succeeds, so that lost or repeated attempts leave
nothing but stray temporary files, which the commit removes. The commit renames the files
in order and writes the manifest last: an archive without one isn't complete.

Of records with equal payloads of `least` bytes or more, the one with the largest page is
a response; the others are revisits that refer to it. Headers and digests are generated
from the payload; reading checks each response's digest again.

Null html is an empty payload, null url an empty target. Rows without a page keep none
(`null`), sort first and are never referred to while another page has the payload.
Repeated rows of one page and payload: one is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import range_of, ranges, remove, shuffle_partitions, slices, tidy

MANIFEST = "manifest.json"
DATE = "2000-01-01T00:00:00Z"
#: Bytes that count for a record besides its payload; ranges that an archive has at least.
HEADERS, RANGES = 600, 48
ATTEMPTS = "part int, place int, name string, records bigint, bytes bigint, sha256 string"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an output folder, for workers."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri) if ":" in uri else f"file://{uri}")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([f"{first}\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def record(page: int | None, url: str, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record; digest in hex."""
    based = base64.b32encode(bytes.fromhex(digest)).decode()
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest))]
    lines += [("WARC-Payload-Digest", f"sha1:{based}"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines, "WARC/1.1") + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time in the header
    return packer.compress(data) + packer.flush()


def _sorted_records(df: DataFrame, key: str, url: str, html: str, least: int, most: int, folder: str) -> DataFrame:
    """page, url, payload, digest, keeps, is_record: range-sorted. A row that isn't a record tells which page keeps the payload of those that follow."""
    payload = F.coalesce(df[html], F.lit("")).cast("binary")
    rows = df.select(df[key].cast("bigint").alias("page"), F.coalesce(df[url].cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # without payloads: those of which there are several, and the page that keeps each
    slim = rows.where(F.octet_length("payload") >= least).select("page", "digest")
    copies = slim.groupBy("digest").agg(F.max("page").alias("keeps"), F.count("*").alias("n")).where("n > 1 AND keeps IS NOT NULL").drop("n")
    copies.write.parquet(f"{folder}/copies")  # a table, so that the join can split a payload of many pages
    copies = df.sparkSession.read.schema(copies.schema).parquet(f"{folder}/copies")
    notes = slim.join(copies, "digest").distinct().select("page", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "keeps", F.lit(False).alias("is_record"))
    # a note about a page's copied payload goes right before the page: payloads are shuffled once
    every = rows.withColumn("keeps", F.lit(None).cast("bigint")).withColumn("is_record", F.lit(True)).unionByName(notes)
    at = F.coalesce("page", F.lit(-(1 << 63)))
    size = F.octet_length(F.coalesce(df[html], F.lit(""))).cast("bigint") + HEADERS
    sizes = df.select(F.coalesce(df[key].cast("bigint"), F.lit(-(1 << 63))).alias("at"), size.alias("n"))
    starts = ranges(sizes, most, RANGES)
    if not len(starts):
        return every
    # a range above the size holds a single page
    shards = np.ones(len(starts), np.int64)
    total = sizes.groupBy(range_of(F.col("at"), starts).alias("range")).agg(F.sum("n").alias("n"))
    limit = max(1, min(most, sizes.agg(F.sum("n")).first()[0] // RANGES))
    for row in total.where(F.col("n") > limit).collect():
        shards[row.range] = min(-(-row.n // limit), 1 << 16)
    first = np.cumsum(shards) - shards

    @F.pandas_udf("int")
    def shard(pages: pd.Series, digests: pd.Series) -> pd.Series:
        k = np.searchsorted(starts, pages.to_numpy(), side="right") - 1
        part = np.array([int(d[:4], 16) for d in digests], np.int64)
        return pd.Series(first[k] + part * shards[k] // (1 << 16))

    order = ["shard", "page", "digest", "is_record", "url"]
    dealt = every.withColumn("shard", shard(at, F.col("digest"))).repartitionById(int(shards.sum()), "shard")
    return dealt.sortWithinPartitions(*order).select("page", "url", "payload", "digest", "keeps", "is_record")


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, roll: int = 256_000_000, most: int = 1_000_000_000) -> list[dict]:
    """Writes the archive and commits it; returns the manifest's files. folder: a new folder that all executors share; roll: compressed size of a file; most: payload bytes of a range, less if that makes fewer than RANGES."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, path = open_folder(f"{folder}/tmp")
        files.create_dir(path, recursive=True)
        rows, out, name, size, n, digest = [], None, "", 0, 0, hashlib.sha256()
        noted, keeper, kept = None, None, False

        def close() -> None:
            out.close()
            rows.append((part, len(rows), name, n, size, digest.hexdigest()))

        for batch in slices(batches, 64):
            for page, target, payload, sha, keeps, is_record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_record:
                    noted, keeper, kept = (page, sha), keeps, False
                    continue
                copied = noted == (page, sha)
                mine = copied and keeper == page and not kept  # of equal rows the first is the response
                kept = kept or mine
                packed = _gzip(record(page, target, payload, sha, keeper, copied and not mine))
                if out is not None and size + len(packed) > roll:
                    close()
                    out = None
                if out is None:
                    name, size, n, digest = f"{part:05d}-{len(rows):05d}-{attempt}", 0, 0, hashlib.sha256()
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                out.write(packed)
                digest.update(packed)
                size += len(packed)
                n += 1
        if out is not None:
            close()
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["part", "place", "name", "records", "bytes", "sha256"])

    written = _sorted_records(df, key, url, html, least, most, folder).mapInArrow(tidy(run), ATTEMPTS)
    written.write.parquet(f"{folder}/attempts")  # one attempt of each task
    return _commit(spark, folder)


def _commit(spark: SparkSession, folder: str) -> list[dict]:
    found = spark.read.schema(ATTEMPTS).parquet(f"{folder}/attempts").orderBy("part", "place").toLocalIterator()
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = []
    for row in found:
        final = f"part-{row.part:05d}-{row.place:05d}.warc.gz"
        if not files.rename(path(f"tmp/{row.name}"), path(final)) and not files.exists(path(final)):
            raise OSError(f"{row.name} is missing")
        listed.append({"name": final, "records": row.records, "bytes": row.bytes, "sha256": row.sha256})
    out = files.create(path(f"tmp/{MANIFEST}"), True)
    out.write(bytearray(json.dumps({"files": listed}).encode()))
    out.close()
    if not files.rename(path(f"tmp/{MANIFEST}"), path(MANIFEST)):
        raise OSError(f"{folder} has a manifest already")
    remove(spark, f"{folder}/tmp")
    remove(spark, f"{folder}/attempts")
    remove(spark, f"{folder}/copies")
    return listed


def records(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip file, a member at a time."""
    left = b""
    while left or (left := stream.read(chunk)):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = left or stream.read(chunk)
            if not data:
                raise EOFError("a record is cut off")
            parts.append(unpack.decompress(data))
            left = unpack.unused_data
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of a committed archive; payloads: with the payload as `html` (null for revisits)."""
    text = "".join(r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect())
    names = [(f["name"],) for f in json.loads(text)["files"]]
    files = spark.createDataFrame(names, "name string").repartition(max(1, min(len(names), 4 * shuffle_partitions(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: int(p) if (p := x.split(":")[2]) else None
        system, path = open_folder(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * payloads]
        titles = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * payloads]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']} doesn't match its digest")
                        row = (of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], of(headers["WARC-Refers-To"]) if revisit else None)
                        rows.append((*row, None if revisit else payload.decode()) if payloads else row)
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], titles)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], titles)

    return files.mapInArrow(tidy(run), READ + ", html string" * payloads)


#: The pages' records in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeps FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN keeps <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeps <> page_id THEN keeps END AS refers_to
FROM p LEFT JOIN k ON p.payload_bytes >= 1000 AND p.payload_digest = k.payload_digest
"""
