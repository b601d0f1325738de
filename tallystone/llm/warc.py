"""WARC archives with an index of byte ranges.

Writing gives one index row per record: file, offset, length, URL and digest.
Reading starts from the index: the selected rows are sorted by file and offset,
neighbouring ranges are coalesced into one read, and each record's own gzip
member is cut from it. Records between selected ones are skipped unparsed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import filesystem, finish_steps, named
from tallystone.session import materialise, scratch_path

INDEX = "path string, offset long, length long, url string, payload_digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """One gzip member: a response, or a revisit of page ``first`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {first}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _parsed(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number("Refers-To-Page-ID"),
        "payload_bytes": int(sizes["Content-Length"]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def write_archives(
    pages: DataFrame, min_bytes: int = 0, file_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write every row as a record into archives of about ``file_bytes``; returns the index.

    Payload: the text in UTF-8, null as empty. Of the rows with equal payloads of at
    least ``min_bytes``, those with the smallest id are responses (repeated rows of it
    too), the others revisit it; smaller payloads are all responses. A null id counts
    as largest; if all ids of a payload are null, all its rows are responses. A null
    URL gives a record without target. Payloads are compared by SHA-256, and only
    (digest, smallest id) is aggregated, so a payload shared by a third of all pages
    collapses before the shuffle.
    """
    spark = pages.sparkSession
    finish_steps(spark)
    rows = pages.select(
        named(id_col).cast("long").alias("page_id"),
        named(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(named(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    firsts = rows.groupBy("same").agg(F.min("page_id").alias("first"))
    first = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(firsts, "same").select("page_id", "url", "payload", first.alias("first"))
    folder = scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    # a task that runs again writes other files; only the index of the one that ended counts
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                member = _record(row["page_id"], row["url"], row["payload"], digest, row["first"], date)
                out.write(member)
                kind = "response" if row["first"] is None else "revisit"
                found.append((f"{folder}/{name}", at, len(member), row["url"], digest, kind, row["page_id"]))
                at += len(member)
            if found:
                names = ["path", "offset", "length", "url", "payload_digest", "record_type", "page_id"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return materialise(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of the given index rows.

    Rows of one file come sorted by offset; ranges at most ``gap`` bytes apart are
    read at once, up to ``most`` bytes a read (a longer record is read alone).
    """
    spark = index.sparkSession
    files = max(1, index.select("path").distinct().count())  # a task per file: the index is small, what it points to is not
    ranges = index.select("path", "offset", "length").repartition(files, "path").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        source, opened = None, None

        def fetched(path, run):
            nonlocal source, opened
            if path != opened:
                fs, base = filesystem(path)
                source, opened = fs.open_input_file(base), path
            lo, hi = run[0][0], run[-1][0] + run[-1][1]
            source.seek(lo)
            data = source.read(hi - lo)
            return pa.RecordBatch.from_pylist([_parsed(data[o - lo : o - lo + n]) for o, n in run], schema)

        path, run = None, []
        for batch in batches:
            for row in batch.to_pylist():
                o, n = row["offset"], row["length"]
                if run and (row["path"] != path or o - sum(run[-1]) > gap or o + n - run[0][0] > most):
                    yield fetched(path, run)
                    run = []
                path = row["path"]
                run.append((o, n))
        if run:
            yield fetched(path, run)

    return ranges.mapInArrow(read, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records and read back through the index."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
