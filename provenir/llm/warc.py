"""WARC archives: writing, normalising monolithic gzip, reading back.

A WARC file that was compressed as one gzip stream can't be read from the middle. The normaliser inflates such a file
once, as a stream, finds the records by their lengths, writes each as a gzip member of its own to a new file, and beside
it an index (a JSON line for each record: offset, length, type, target, page). A record is then read by its range alone.
Files are addressed by URI in the folder that all executors share, through pyarrow's file systems. Each attempt of a task
writes under a name of its own, and only files that a finished task reports are used, so a lost executor costs a repeat.

Defined results: null html is an empty payload; a null url is given as urn:page; control characters in it are
percent-encoded; rows without page_id are written without one, and are responses only where no other row has their
payload; rows equal in page_id and payload are responses both; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import dealt_join, prepare, scratch

#: A task starts a new archive after so many bytes of records; level of compression.
ARCHIVE_BYTES, LEVEL = 64 << 20, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or where refers_to is given a revisit of that page's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    sha1, revisit = digest(payload), refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{sha1}')}>", "WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(chunks: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, a bounded piece at a time."""
    d = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out = d.decompress(chunk, step)
            if out:
                yield out
            chunk = d.unconsumed_tail
            if d.eof:
                chunk, d = d.unused_data, zlib.decompressobj(31)
    if out := d.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, bytes) of each record of an inflated stream; memory is bounded by the largest record."""
    held, start = bytearray(), 0
    source = iter(pieces)

    def fill(size: int) -> bool:
        nonlocal held, start
        while len(held) - start < size:
            piece = next(source, None)
            if piece is None:
                return False
            if start > 1 << 22:
                del held[:start]
                start = 0
            held += piece
        return True

    while fill(1):
        seen = start
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            have, before = len(held) - start, max(0, len(held) - start - 3)
            if not fill(have + 1):
                raise ValueError("a WARC header is cut off")
            seen = start + before
        head = end + 4 - start
        fields = parse_head(bytes(held[start : end]))
        total = head + int(fields["content-length"]) + 4
        if not fill(total):
            raise ValueError("a WARC record is cut off")
        yield fields, bytes(held[start : start + total])
        start += total


class _Writer:
    """One gzip stream of records; a new file begins after ARCHIVE_BYTES."""

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.done = None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.n, self.z = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            self.out = self.fs.open_output_stream(self.name, compression=None)
        self.out.write(self.z.compress(data))
        self.size, self.n = self.size + len(data), self.n + 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.z.flush())
            self.out.close()
            self.done.append((self.name, self.n))
            self.out = None


def packed(html: Column) -> Column:
    """UTF-8 of a text by Zstandard, so that little is shuffled."""

    @F.arrow_udf("binary")
    def pack_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            yield pa.array([codec.compress((x.as_py() or "").encode(), asbytes=True) for x in batch], pa.binary())

    return pack_html(html)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, records): files in folder, each one gzip stream, of pages (page_id, url, refers_to, html packed, size)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, codec = _Writer(folder), pa.Codec("zstd")
        for batch in batches:
            for page_id, url, html, size, refers_to in zip(*(batch.column(i) for i in range(5))):
                payload = codec.decompress(html.as_buffer(), decompressed_size=size.as_py(), asbytes=True) if size.as_py() else b""
                writer.add(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py()))
        writer.close()
        yield pa.record_batch({"archive": pa.array([a for a, _ in writer.done], pa.string()), "records": pa.array([n for _, n in writer.done], pa.int64())})

    return pages.select("page_id", "url", "html", "size", "refers_to").mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, index, records): each archive of archives rewritten, a member a record, with its index beside it."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, to = filesystem(folder)
        rows = []
        for batch in batches:
            for name in batch.column(0):
                new, n, at = f"{to}/{uuid.uuid4().hex}", 0, 0
                with fs.open_input_stream(name.as_py(), compression=None) as source, fs.open_output_stream(f"{new}.warc.gz", compression=None) as out, fs.open_output_stream(f"{new}.idx", compression=None) as index:
                    for fields, data in records(inflate(iter(lambda: source.read(1 << 18), b""))):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "type": fields["warc-type"], "target": fields["warc-target-uri"], "digest": fields["warc-payload-digest"], "page": fields.get("x-page-id")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, n = at + len(member), n + 1
                rows.append((f"{new}.warc.gz", f"{new}.idx", n))
        yield pa.record_batch({"archive": pa.array([r[0] for r in rows], pa.string()), "index": pa.array([r[1] for r in rows], pa.string()), "records": pa.array([r[2] for r in rows], pa.int64())})

    return archives.select("archive").mapInArrow(rewrite, "archive string, index string, records long")


_ENTRY = "page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives (archive, index), each read by its range and checked: a response's
    payload has the digest stated, a revisit states that of the payload it stands for. html is null for revisits."""
    kinds = [("page_id", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]

    def one(member: bytes) -> tuple:
        data = zlib.decompress(member, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = parse_head(head)
        block = rest[: int(fields["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
        stated, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if digest(block) != fields["warc-block-digest"].removeprefix("sha1:") or (kind == "response" and (len(payload) != size or digest(payload) != stated)):
            raise ValueError(f"record {fields['warc-record-id']} does not have its digest")
        number = lambda k: int(fields[k]) if k in fields else None
        return number("x-page-id"), fields["warc-target-uri"], size, stated, kind, number("x-refers-to-page-id"), payload.decode() if kind == "response" else None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for name, index in zip(batch.column(0), batch.column(1)):
                with fs.open_input_file(name.as_py()) as source, fs.open_input_stream(index.as_py(), compression=None) as lines:
                    rows, size = [], 0
                    for entry in map(json.loads, lines.read().splitlines()):
                        rows.append(one(source.read_at(entry["length"], entry["offset"])))
                        size += rows[-1][2]
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    return archives.select("archive", "index").mapInArrow(load, _ENTRY)


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with html packed, its size in bytes, and refers_to: the greatest page_id of those with an
    equal payload of at least least_bytes, null for that page itself and for smaller payloads.

    A payload of very many pages (an empty or an error page, say) is dealt to several tasks by page_id."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("key"))
    holders = keyed.where(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").checkpoint()
    joined = dealt_join(keyed.withColumn("html", packed(F.col("html"))), holders, ["key"], F.struct("page_id", "url"))
    return joined.select("page_id", "url", "html", "size", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages written to monolithic archives, these normalised, and the records read back by their index."""
    spark = prepare(pages.sparkSession)
    folder = scratch(spark, "warc")
    raw = write_monolithic(with_references(pages, least_bytes), f"{folder}/raw").checkpoint()
    spread = lambda df: df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")
    made = normalise(spread(raw), f"{folder}/raw").checkpoint()
    return read(spread(made), f"{folder}/raw")


def column_digest(html: Column) -> Column:
    """The digest of a column, for what is not in an archive."""

    @F.arrow_udf("string")
    def payload_digest(batch: pa.Array) -> pa.Array:
        return pa.array([digest((x.as_py() or "").encode()) for x in batch], pa.string())

    return payload_digest(html)
