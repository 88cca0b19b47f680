"""Media columns: Matroska files, parsed to packet tables.

mux() stores bytes as an audio track of unsigned 8-bit PCM samples: frames of FRAME samples, laced LACED to a block, the
blocks in clusters with cues. parse() reads any Matroska file whose structure is given by EBML elements: variable-length
ids and sizes (also unknown sizes of segments and clusters), SimpleBlocks and BlockGroups, the four ways of lacing, and
cues; it gives a packet for each frame, with its track, time and range of bytes in the file, and never copies frames.

Defined results: a null text is the empty one; a payload is padded with bytes 0 to a positive multiple of 64, so the empty
text has 64 of them; null media have no packets; media that end within an element, lack a part that it needs, or have a size
that leads out of its parent, raise ValueError in parse(), and give nulls in packets() and features().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import carried, prefixed, prepare, quoted

#: Samples a second, samples a frame, frames a block, blocks a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 4
#: Element ids of the public format.
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY, NUMBER, KIND, CODEC = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")


def vint(value: int, width: int = 0) -> bytes:
    """A size as EBML writes it, in as few bytes as hold it, or in width."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_ebml(sizes: list[int]) -> bytes:
    """Sizes of all frames but the last: the first as it is, each other as a signed difference."""
    out = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        d = b - a
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
        out.append(vint(d + (1 << 7 * width - 1) - 1, width))
    return b"".join(out)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one audio track of the payload's bytes as samples."""
    ms = 1000 / RATE
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4489, struct.pack(">d", len(payload) * ms)) + element(0x4D80, b"provenir") + element(0x5741, b"provenir"))
    audio = element(0xE1, element(0xB5, struct.pack(">d", float(RATE))) + uint(0x9F, 1) + uint(0x6264, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(KIND, 2) + uint(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + uint(0x23E383, FRAME * 1_000_000_000 // RATE) + audio))
    head = info + tracks
    clusters, cues, at = [], [], len(head)
    for a in range(0, len(payload), FRAME * LACED * BLOCKS):
        time = int(a * ms)
        blocks = []
        for b in range(a, min(len(payload), a + FRAME * LACED * BLOCKS), FRAME * LACED):
            body = payload[b : b + FRAME * LACED]
            sizes = [min(FRAME, len(body) - i) for i in range(0, len(body), FRAME)]
            if len(sizes) == 1:
                flags, lace = 0x80, b""
            elif sizes[0] == sizes[-1]:
                flags, lace = 0x84, bytes([len(sizes) - 1])
            else:
                flags, lace = 0x86, bytes([len(sizes) - 1]) + lace_ebml(sizes)
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", int(b * ms) - time, flags) + lace + body))
        cluster = element(CLUSTER, uint(TIMESTAMP, time) + b"".join(blocks))
        cues.append(element(POINT, uint(CUE_TIME, time) + element(POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        clusters.append(cluster)
        at += len(cluster)
    ebml = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    return ebml + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    time_ns: int
    start: int
    end: int
    keyframe: bool
    cluster: int
    block: int
    lacing: str


@dataclass
class Media:
    tracks: dict[int, str] = field(default_factory=dict)
    durations: dict[int, int] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time_ns, track, byte of the cluster
    clusters: int = 0
    blocks: int = 0


def _vint(data: memoryview, at: int, keep: bool) -> tuple[int, int]:
    """(value, next byte); an id keeps its length marker, and -1 is an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def _children(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements in a range."""
    while at < end:
        ident, body = _vint(data, at, True)
        size, body = _vint(data, body, False)
        if size >= 0:
            to = body + size
        elif ident in (SEGMENT, CLUSTER):
            to = end if ident == SEGMENT else _stop_of(data, body, end)
        else:
            raise ValueError(f"element {ident:x} has no size")
        if to > end:
            raise ValueError(f"element {ident:x} at byte {at} leads out of its parent")
        yield ident, body, to
        at = to


def _stop_of(data: memoryview, at: int, end: int) -> int:
    """Where a cluster of unknown size ends."""
    while at < end:
        ident, body = _vint(data, at, True)
        if ident in (CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML):
            return at
        size, body = _vint(data, body, False)
        at = body + size
    return end


def _uint(data: memoryview, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _block(data: memoryview, a: int, b: int, simple: bool) -> tuple[int, int, bool, str, list[tuple[int, int]]]:
    """(track, relative time, keyframe, lacing, ranges of frames) of a block's bytes."""
    track, a = _vint(data, a, False)
    if a + 3 > b:
        raise ValueError("a block is cut off")
    time, flags = struct.unpack_from(">hB", data, a)
    a += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80) or not simple, "none", [(a, b)]
    n, a = data[a] + 1, a + 1
    if lacing == 2:
        if (b - a) % n:
            raise ValueError("frames of equal size don't fill their block")
        sizes = [(b - a) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == 1:
                size = 0
                while data[a] == 255:
                    size, a = size + 255, a + 1
                size, a = size + data[a], a + 1
            elif not i:
                size, a = _vint(data, a, False)
            else:
                width = 9 - data[a].bit_length()
                raw, a = _vint(data, a, True)
                size = sizes[-1] + (raw & (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames lead out of their block")
    ends = np.cumsum([a, *sizes]).tolist()
    return track, time, bool(flags & 0x80) or not simple, LACINGS[lacing], list(zip(ends, ends[1:]))


def parse(content: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; ValueError for whatever is no such file."""
    try:
        return _parse(content)
    except (StopIteration, KeyError, IndexError, OverflowError, struct.error) as e:
        raise ValueError(f"an element is cut off or lacks a part: {e!r}") from e


def _parse(content: bytes) -> Media:
    data, out, scale = memoryview(content), Media(), 1_000_000
    for ident, a, b in _children(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for kind, c, d in _children(data, a, b):
            if kind == INFO:
                scale = next((_uint(data, e, f) for x, e, f in _children(data, c, d) if x == SCALE), scale)
            elif kind == TRACKS:
                for _, e, f in (x for x in _children(data, c, d) if x[0] == ENTRY):
                    own = {x: (g, h) for x, g, h in _children(data, e, f)}
                    number = _uint(data, *own[NUMBER])
                    out.tracks[number] = bytes(data[slice(*own[CODEC])]).decode() if CODEC in own else ""
                    out.durations[number] = _uint(data, *own[0x23E383]) if 0x23E383 in own else 0
            elif kind == CLUSTER:
                time = 0
                for x, e, f in _children(data, c, d):
                    if x == TIMESTAMP:
                        time = _uint(data, e, f)
                    elif x in (SIMPLE, GROUP):
                        key = True
                        if x == GROUP:
                            inner = {y: (g, h) for y, g, h in _children(data, e, f)}
                            (e, f), key = inner[BLOCK], REFERENCE not in inner
                        track, ticks, flagged, lacing, frames = _block(data, e, f, x == SIMPLE)
                        each = out.durations.get(track, 0)
                        out.packets += [Packet(track, (time + ticks) * scale + i * each, g, h, flagged and key, out.clusters, out.blocks, lacing) for i, (g, h) in enumerate(frames)]
                        out.blocks += 1
                out.clusters += 1
            elif kind == CUES:
                for _, e, f in (x for x in _children(data, c, d) if x[0] == POINT):
                    point = list(_children(data, e, f))
                    when = next(_uint(data, g, h) for y, g, h in point if y == CUE_TIME)
                    for g, h in ((g, h) for y, g, h in point if y == POSITIONS):
                        where = {y: _uint(data, i, j) for y, i, j in _children(data, g, h)}
                        out.cues.append((when * scale, where[CUE_TRACK], a + where[CUE_CLUSTER]))
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """(bytes of a text, padded; bytes before that)."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def media(text: Column) -> Column:
    """A text's padded bytes as a Matroska file."""

    @F.arrow_udf("binary")
    def to_matroska(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([mux(padded(x.as_py())[0]) for x in batch], pa.binary())

    return to_matroska(text)


_PACKET = "track:bigint,time_ns:bigint,start:bigint,end:bigint,keyframe:boolean,cluster:bigint,block:bigint,lacing:string"


def packets(df: DataFrame, column: str = "media") -> DataFrame:
    """A row for each packet, beside df's other columns (but those named like a packet's); media that can't be parsed give
    one row of nulls."""
    prepare(df.sparkSession)

    @F.arrow_udf(f"array<struct<{_PACKET}>>")
    def packets_of(batch: pa.Array) -> pa.Array:
        def one(content: bytes | None) -> list[dict] | None:
            try:
                return [vars(p) for p in parse(content).packets] if content is not None else None
            except ValueError:
                return None

        fields = [("track", pa.int64()), ("time_ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int64()), ("block", pa.int64()), ("lacing", pa.string())]
        return pa.array([one(x.as_py()) for x in batch], pa.list_(pa.struct(fields)))

    own = [x.split(":")[0] for x in _PACKET.split(",")]
    found = df.select(*prefixed(df)).withColumn("p", F.explode_outer(packets_of(quoted(f"in_{column}"))))
    return found.select(*carried(df, [*own, column]), "p.*")


def features_of(content: bytes) -> tuple[int, str, int, str]:
    """(bytes, SHA-256, CRC-32 of the last 64, features) of the frames in a file, read back by their packets."""
    found = parse(content)
    view = memoryview(content)
    payload = b"".join(view[p.start : p.end] for p in found.packets)
    samples = np.frombuffer(payload, np.uint8)
    wide = samples.astype(np.int64)
    above = samples >= 128
    loud = [int(wide[i : i + (1 << 16)] @ wide[i : i + (1 << 16)]) for i in range(0, len(wide), 1 << 16)]
    feature = f"packets={len(found.packets)};blocks={found.blocks};clusters={found.clusters};cues={len(found.cues)};last_ns={found.packets[-1].time_ns if found.packets else 0};sum={int(wide.sum())};squares={sum(loud)};crossings={int((above[1:] != above[:-1]).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature


def features(content: Column) -> Column:
    """struct<payload_bytes, payload_sha256, tail_crc32, feature> of a media column; null for null, and for media that can't be
    parsed."""

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string>")
    def media_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])

        def one(content: bytes | None) -> dict | None:
            try:
                return None if content is None else dict(zip(kind.names, features_of(content)))
            except ValueError:
                return None

        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], kind)

    return media_features(content)
