import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from provenir.llm import warc


def want(pages, least=0):
    best = {}
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= least and i is not None:
            best[h] = max(best.get(h, -1), i)
    out = []
    for i, _, h in pages:
        h = h or ""
        raw, holder = h.encode(), best.get(h) if len(h.encode()) >= least else None
        revisit = holder is not None and holder != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é漢" * 5000), (7, "u", "only"), (None, "u", "same"), (None, None, "alone"), (7, "u", "only"), (8, "u", "WARC/1.1\r\n\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages, least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(PAGES, least)
    assert sorted(r.html for r in got if r.record_type == "response") == sorted((h or "") for (i, _, h), w in zip(sorted(PAGES, key=str), [None] * 99) if any(x[0] == i and x[3] == "response" and x[1] == len((h or "").encode()) for x in want(PAGES, least)))


def test_each_member_stands_alone(tmp_path, spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50, None) for i in range(20)], "page_id long, url string, html string, refers_to long").coalesce(1)
    pages = pages.withColumn("size", F.octet_length("html").cast("long")).withColumn("html", warc.packed(F.col("html")))
    raw = warc.write_monolithic(pages, f"{tmp_path}/raw").checkpoint()
    made = warc.normalise(raw, f"{tmp_path}/raw").checkpoint().collect()
    data = b"".join(open(r.archive, "rb").read() for r in made)
    members = 0
    while data:
        d = zlib.decompressobj(31)
        assert d.decompress(data).startswith(b"WARC/1.1\r\n") and d.eof
        data, members = d.unused_data, members + 1
    assert members == 20 and sum(r.records for r in made) == 20


def test_inflate_reads_members_and_pieces():
    whole = b"x" * 3_000_000 + b"end"
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    stream = z.compress(whole) + z.flush()
    both = stream * 2
    pieces = list(warc.inflate((both[i : i + 7] for i in range(0, len(both), 7)), step=1000))
    assert b"".join(pieces) == whole * 2 and max(map(len, pieces)) <= 1000


def test_cut_off_archive_raises():
    data = warc.record(1, "u", b"payload", None)
    for cut in (10, len(data) - 3):
        with pytest.raises(ValueError):
            list(warc.records(iter([data[:cut]])))
    assert [f["x-page-id"] for f, _ in warc.records(iter([data[:40], data[40:], data]))] == ["1", "1"]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
