"""Corpora of files, journals, and blob tables."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import stat
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.session import stored

_STEP = 1 << 20


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether a path is there, by the file system that Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _opened(uri: str) -> tuple[arrow_fs.FileSystem, str, bool]:
    """(file system, path in it, whether it is this machine's)."""
    if not re.match(r"\w+:", uri):
        uri = "file://" + os.path.abspath(uri)
    found, path = arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return found, path.rstrip("/"), isinstance(found, arrow_fs.LocalFileSystem)


def _below(uri: str, folder: str) -> Iterator[tuple[str, str | None, bool]]:
    """(path from the root, why it is left out, whether it is a folder) of a folder's entries; links are never followed."""
    found, root, local = _opened(uri)
    if not local:
        for info in found.get_file_info(arrow_fs.FileSelector(posixpath.join(root, folder), recursive=False)):
            is_dir = info.type == arrow_fs.FileType.Directory
            yield posixpath.join(folder, info.base_name), None if is_dir or info.is_file else "not a regular file", is_dir
        return
    try:
        entries = list(os.scandir(os.path.join(root, folder)))
    except OSError as e:
        yield folder, f"unreadable: {e.strerror}", False
        return
    for entry in entries:
        mode = entry.stat(follow_symlinks=False).st_mode
        why = "symlink" if stat.S_ISLNK(mode) else None if stat.S_ISREG(mode) or stat.S_ISDIR(mode) else "not a regular file"
        yield posixpath.join(folder, entry.name), why, stat.S_ISDIR(mode)


def _hashed(uri: str, path: str) -> tuple[str | None, int | None, str | None]:
    """(SHA-256, size, why not) of a file, read a step at a time."""
    found, root, _ = _opened(uri)
    digest, size = hashlib.sha256(), 0
    try:
        with found.open_input_stream(posixpath.join(root, path), compression=None) as source:
            while step := source.read(_STEP):
                digest.update(step)
                size += len(step)
    except OSError as e:
        return None, None, f"unreadable: {os.strerror(e.errno) if e.errno else e}"
    return digest.hexdigest(), size, None


def scan_corpus(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size, reason) of every file below root, path relative to it; hidden files too. What can't be hashed has
    a reason (symlink, not a regular file, unreadable) and no digest; links are not followed.

    Folders are listed a level at a time, in parallel; files are dealt out and hashed in steps of a MB, so that a file of any
    size passes. root is a path or URI that all executors can read."""
    tasks = max(1, spark.sparkContext.defaultParallelism)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for folder in batch.column(0).to_pylist() for x in _below(root, folder)]
            yield pa.record_batch({"path": pa.array([r[0] for r in rows], pa.string()), "reason": pa.array([r[1] for r in rows], pa.string()), "is_dir": pa.array([r[2] for r in rows], pa.bool_())})

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, reasons = (batch.column(i).to_pylist() for i in (0, 1))
            rows = [_hashed(root, p) if why is None else (None, None, why) for p, why in zip(paths, reasons)]
            yield pa.record_batch({"path": pa.array(paths, pa.string()), "sha256": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int64()), "reason": pa.array([r[2] for r in rows], pa.string())})

    folders, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        entries = stored(folders.repartition(tasks, "path").mapInArrow(listing, "path string, reason string, is_dir boolean"))
        files = entries.where("not is_dir or reason is not null").select("path", "reason")
        found = files if found is None else found.unionByName(files)
        folders = entries.where("is_dir and reason is null").select("path")
        if folders.isEmpty():
            break
    name = F.element_at(F.split("path", "/", -1), -1)
    if pattern != "*":
        match = F.udf(lambda x: fnmatchcase(x, pattern), "boolean")
        found = found.where(match(name))
    return found.repartition(tasks * 4, "path").mapInArrow(hashing, "path string, sha256 string, size long, reason string")


def export_blob(blobs: DataFrame, digest: str, path: str) -> int:
    """Write the blob of a digest (blobs: digest, content) to a new local file, verified; returns its size. An existing file
    is never overwritten, and one that does not have its digest is not kept."""
    rows = blobs.where(F.col("digest") == digest).select("content").limit(1).collect()
    if not rows:
        raise KeyError(digest)
    content = bytes(rows[0]["content"])
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"the blob of {digest} was altered")
    with open(path, "xb") as out:
        out.write(content)
    return len(content)


def materialise(manifest: DataFrame, blobs: DataFrame, folder: str) -> int:
    """Write the files of a snapshot (path, digest) below a new folder that all executors share, contents from blobs (digest,
    content); returns their number. Before a byte is written, every path must be safe and every blob there; each is verified
    as it is written, and no file is overwritten."""
    from provenir.operators.manifests import safe_path

    unsafe = manifest.where(~F.coalesce(safe_path(F.col("path")), F.lit(False))).limit(1).count()
    lost = manifest.join(blobs.select("digest").distinct(), "digest", "left_anti").limit(1).count()
    if unsafe or lost:
        raise ValueError("a path is not safe" if unsafe else "a blob is missing")
    if exists(manifest.sparkSession, folder):
        raise FileExistsError(folder)

    def write(rows) -> None:
        found, root, _ = _opened(folder)
        for row in rows:
            content = bytes(row["content"])
            if hashlib.sha256(content).hexdigest() != row["digest"]:
                raise ValueError(f"the blob of {row['path']} was altered")
            path = posixpath.join(root, row["path"])
            found.create_dir(posixpath.dirname(path), recursive=True)
            # A task that is tried again writes the same bytes under a name of its own first.
            part = f"{path}.{os.getpid()}.part"
            with found.open_output_stream(part, compression=None) as out:
                out.write(content)
            found.move(part, path)

    listed = manifest.select("path", "digest").dropDuplicates(["path"])
    listed.join(blobs.select("digest", F.col("content").cast("binary").alias("content")).dropDuplicates(["digest"]), "digest").foreachPartition(write)
    return listed.count()


def _ends_with_newline(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getFileStatus(path).getLen()
    if not size:
        return True
    source = system.open(path)
    try:
        source.seek(size - 1)
        return source.read() == 10
    finally:
        source.close()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines numbered from 0 by their place. The file is read in splits; their lines are counted
    first, one number a split, and a line's number is those before its split plus its place in it."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    counted = lines.groupBy("start").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("start").collect()
    before, offsets = 0, []
    for r in counted:
        offsets.append((r["start"], before - r["first"]))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(offsets, "start long, shift long"))
    return lines.join(shift, "start").select((F.col("at") + F.col("shift")).alias("line"), "value")


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, observations) of a journal: a header line, then a JSON object a line. A last line without an end is torn and
    left out; line numbers are places in the file."""
    ended = numbered_lines(spark, path)
    if not _ends_with_newline(spark, path):
        ended = ended.where(F.col("line") < F.lit(ended.agg(F.max("line")).first()[0]))
    schema = "path string, lane string, status string, backend string, run_id string, record_id string, artifact_hash string, input_sha256 string, failure struct<reason:string,detail:string>, telemetry struct<wall_time_seconds:double,cpu_time_seconds:double,peak_memory_bytes:bigint>, detail string, `at` string"
    rows = ended.where("line > 0").select("line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("line", "o.*")
    return ended.where("line = 0").select("value"), rows


def append_blobs(files: DataFrame, table: str) -> None:
    """Add the contents (digest, content) that a blob table (Parquet at table) lacks; each once. One writer at a time."""
    spark = files.sparkSession
    new = files.select("digest", "content").dropDuplicates(["digest"])
    if exists(spark, table):
        new = new.join(spark.read.parquet(table).select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(table)


def read_waivers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, lane string, outcome string, reason string").json(path, multiLine=True)
