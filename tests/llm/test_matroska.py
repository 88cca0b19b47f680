import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.llm import matroska as m


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 70_000), st.integers(0, 255))
def test_round_trip(n, seed):
    payload = bytes((i * 31 + seed) & 255 for i in range(n))
    content = m.mux(payload)
    found = m.parse(content)
    assert b"".join(content[p.start : p.end] for p in found.packets) == payload
    assert [p.time_ns for p in found.packets] == [i * m.FRAME * 1_000_000_000 // m.RATE for i in range(len(found.packets))]
    assert len(found.cues) == found.clusters and all(content[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in found.cues)


def block(lacing, frames, lace):
    return b"\x81" + struct.pack(">hB", 5, 0x80 | lacing << 1) + (bytes([len(frames) - 1]) + lace if lacing else b"") + b"".join(frames)


@pytest.mark.parametrize("lacing,frames,lace", [(0, [b"abc"], b""), (1, [b"x" * 255, b"y" * 600, b"z"], bytes([255, 0, 255, 255, 90])), (2, [b"ab", b"cd", b"ef"], b""), (3, [b"x" * 800, b"y" * 500, b"z" * 1000], m.lace_ebml([800, 500, 1000])), (3, [b"", b"q" * 20000, b""], m.lace_ebml([0, 20000, 0]))])
@pytest.mark.parametrize("group", [False, True])
@pytest.mark.parametrize("unknown", [False, True])
def test_lacing(lacing, frames, lace, group, unknown):
    body = block(lacing, frames, lace)
    one = m.element(m.GROUP, m.element(m.BLOCK, body) + m.uint(m.DURATION, 3) + m.uint(m.REFERENCE, 1)) if group else m.element(m.SIMPLE, body)
    inner = m.uint(m.TIMESTAMP, 1000) + one
    cluster = b"\x1f\x43\xb6\x75" + b"\xff" + inner if unknown else m.element(m.CLUSTER, inner)
    tracks = m.element(m.TRACKS, m.element(m.ENTRY, m.uint(m.NUMBER, 1) + m.element(m.CODEC, b"A_TEST")))
    segment = tracks + m.element(0xEC, b"\0" * 9) + cluster + cluster
    content = m.element(m.EBML, b"") + (b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + segment if unknown else m.element(m.SEGMENT, segment))
    found = m.parse(content)
    assert [content[p.start : p.end] for p in found.packets] == frames * 2
    assert {p.time_ns for p in found.packets} == {1_005_000_000} and found.clusters == 2 and found.tracks == {1: "A_TEST"}
    assert all(p.keyframe != group for p in found.packets) and found.packets[0].lacing == m.LACINGS[lacing]


def test_cut_off_files_raise():
    content = m.mux(b"x" * 5000)
    for n in (1, 10, 60, len(content) // 2, len(content) - 1):
        with pytest.raises(ValueError):
            m.parse(content[:n])


def test_nasty(nasty, empty):
    import zlib
    from hashlib import sha256

    from pyspark.sql import functions as F

    got = nasty.select("text", m.media(F.col("text")).alias("media")).select("text", "media", m.features(F.col("media")).alias("f")).collect()
    for r in got:
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.f.payload_bytes, r.f.payload_sha256, r.f.tail_crc32) == (len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    stored = nasty.select("doc_id", m.media(F.col("text")).alias("media"), F.lit(1).alias("start"))
    assert m.packets(stored).where("lacing is null").count() == 0
    broken = stored.select("doc_id", F.lit(b"nonsense").alias("media"))
    assert m.packets(broken).where("track is null").count() == nasty.count()
    assert empty.select(m.features(m.media(F.col("text")))).count() == 0


def test_features_against_plain_sums(spark):
    """Numbers of packets, blocks and clusters from sizes alone, and sums over the bytes one by one."""
    from pyspark.sql import functions as F

    texts = ["", "a", "é漢😀" * 20, "x" * 1024, "y" * 8192, "Zz \x7f" * 9000, "ÿ" * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.f for r in docs.select("i", m.features(m.media(F.col("text"))).alias("f")).collect()}
    up = lambda a, b: -(-a // b)
    for i, text in enumerate(texts):
        data = text.encode()
        data += bytes(64 if not data else -len(data) % 64)
        n = up(len(data), 1024)
        blocks, clusters = up(len(data), 8192), up(len(data), 32768)
        last = (n - 1) * 128_000_000
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
        want = f"packets={n};blocks={blocks};clusters={clusters};cues={clusters};last_ns={last};sum={sum(data)};squares={sum(b * b for b in data)};crossings={crossings}"
        assert got[i].feature == want and got[i].payload_bytes == len(data)
