"""Archives written, read whole and in part, against plain Python on the payloads."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallystone.llm import warc
from tallystone.llm.common import filesystem


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(pages, least=0):
    first = {}
    for i, _, t in pages:
        t = t or ""
        if len(t.encode()) >= least:
            held = first.get(t)
            first[t] = i if held is None else held if i is None else min(i, held)
    out = []
    for i, u, t in pages:
        t = t or ""
        one = first.get(t)
        refers = one if one is not None and one != i else None
        out.append((i, u, "response" if refers is None else "revisit", refers, len(t.encode()), digest(t)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()), key=str)


@pytest.fixture
def pages(spark):
    return lambda data: spark.createDataFrame([(*r, 1, "x") for r in data], "page_id long, url string, html string, offset int, path string")


ODD = [
    (5, "http://a/1", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (7, "http://a/3", None), (8, "http://a/4", ""),
    (None, "http://a/5", "alone"), (None, "http://a/6", "<p>é</p>"), (11, "http://ü/?q=1\t2", "x" * 300_000), (12, "http://a/7", "x" * 300_000), (13, "http://a/8", "\r\n\r\nWARC/1.0\r\n"),
    (14, "http://a/9", "s"), (15, "http://a/9", "s"),
]


def test_odd_rows(pages):
    index = warc.write_archives(pages(ODD), file_bytes=500)
    assert index.select("path").distinct().count() > 1
    assert got(warc.read_archives(index)) == brute(ODD)
    bodies = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(index).filter("record_type = 'response'").collect()}
    assert bodies <= {(i, t or "") for i, _, t in ODD} and len(bodies) == len({t or "" for _, _, t in ODD})
    assert got(warc.read_archives(warc.write_archives(pages(ODD), min_bytes=3))) == brute(ODD, 3)
    assert warc.write_archives(pages([])).count() == 0 and warc.read_archives(index.limit(0)).count() == 0


def test_selected_records_only(spark, sf_dir, read):
    index = warc.write_archives(read("pages"))
    some = index.filter((F.col("page_id") % 3 == 0) & F.col("url").contains("://"))
    want = {r.page_id: r.payload_digest for r in some.collect()}
    back = warc.read_archives(some, gap=100, most=5000).collect()
    assert {r.page_id: r.payload_digest for r in back} == want and len(back) == len(want) < index.count()
    row = some.first()  # a record is a gzip member of its own
    fs, path = filesystem(row.path)
    with fs.open_input_file(path) as f:
        f.seek(row.offset)
        assert gzip.decompress(f.read(row.length)).startswith(b"WARC/1.")


def test_a_changed_payload_is_refused():
    record = warc._record(1, "http://a", b"payload", digest("other"), None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc._parsed(record)


def test_table(spark, sf_dir, read):
    want = [(r[0], r[4], r[5], r[2], r[3]) for r in brute([(r.page_id, r.url, r.html) for r in read("pages").collect()])]
    rows = warc.query(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
