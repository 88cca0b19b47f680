"""Content addressing: file digests, trees, blobs, snapshots and their verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.canon import is_digest

NUL = chr(0)


def tree_text(path: Column, digest: Column) -> Column:
    """Aggregate: the canonical text of a tree, path NUL digest NUL in order of path."""
    entries = F.array_sort(F.collect_list(F.struct(path.alias("path"), digest.alias("digest"))))
    return F.array_join(F.transform(entries, lambda x: F.concat(x["path"], F.lit(NUL), x["digest"], F.lit(NUL))), "")


def tree_digest(manifest: DataFrame, *keys: str) -> DataFrame:
    """(keys, files, digest): SHA-256 of each tree's canonical text.

    The hash runs over one tree's sorted manifest, so a tree's entries (paths and digests, not contents) meet in a task."""
    return manifest.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(tree_text(F.col("path"), F.col("digest")), 256).alias("digest"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row, and not again for each element that body looks up in it."""
    return F.transform(F.array(value), body)[0]


def decode_tree(trees: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, digest) of canonical trees (column text); a tree that is not well formed gives none."""
    pair = lambda parts, i: F.struct(F.get(parts, 2 * i - 2).alias("path"), F.get(parts, 2 * i - 1).alias("digest"))
    pairs = let(F.split(F.col(text), NUL, -1), lambda parts: F.transform(F.sequence(F.lit(1), ((F.size(parts) - 1) / 2).cast("int")), lambda i: pair(parts, i)))
    found = trees.where(tree_problem(F.col(text)).isNull() & (F.col(text) != "")).select(*keys, F.explode(pairs).alias("e"))
    return found.select(*keys, "e.path", "e.digest")


def safe_path(path: Column) -> Column:
    """Relative POSIX path without empty, . or .. parts, and without NUL."""
    parts = F.split(path, "/", -1)
    return (path != "") & ~path.contains(NUL) & ~F.exists(parts, lambda x: x.isin("", ".", ".."))


def tree_problem(text: Column) -> Column:
    """What is wrong with a tree's text, or null: truncated, odd, path, digest, order (which covers duplicates) or clash."""
    parts = F.split(text, NUL, -1)
    fields = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    n = F.size(fields)
    paths = F.filter(fields, lambda _, i: i % 2 == 0)
    digests = F.filter(fields, lambda _, i: i % 2 == 1)
    later = let(paths, lambda p: F.filter(p, lambda x, i: (i > 0) & (x <= F.get(p, i - 1))))
    # A file that is also a folder: it is among the folders above the paths, which are looked up by hash.
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.array_join(F.slice(p, 1, k), "/"))
    nested = F.filter(F.transform(paths, lambda x: F.split(x, "/", -1)), lambda p: F.size(p) > 1)
    clash = F.arrays_overlap(paths, F.flatten(F.transform(nested, above)))
    return (
        F.when(text == "", None).when(~F.endswith(text, F.lit(NUL)), "truncated").when(n % 2 == 1, "odd")
        .when(F.exists(paths, lambda x: ~safe_path(x)), "path").when(F.exists(digests, lambda x: ~is_digest(x)), "digest")
        .when(F.size(later) > 0, "order").when(clash, "clash")
    )


def manifest_diff(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, change) of paths that differ or stand on one side only: changed, removed or added."""
    left, right = a.select(*keys, "path", F.col("digest").alias("a")), b.select(*keys, "path", F.col("digest").alias("b"))
    both = left.join(right, [*keys, "path"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*keys, "path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def corpus_drift(manifest: DataFrame, present: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """manifest_diff of a corpus; a present path that the manifest lists as excluded is not an addition."""
    found = present if excluded is None else present.join(excluded.select("path"), "path", "left_anti")
    return manifest_diff(manifest.select("path", "digest"), found.select("path", "digest"))


def verified_blobs(blobs: DataFrame) -> DataFrame:
    """blobs (digest, content) with ok: the content has its digest."""
    return blobs.withColumn("ok", F.sha2(F.col("content").cast("binary"), 256) == F.col("digest"))


def distinct_blobs(files: DataFrame) -> DataFrame:
    """(digest, size, copies): each content once, whatever the number of files that hold it."""
    return files.groupBy("digest").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def missing_blobs(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest entries whose blob is not stored."""
    return manifest.join(blobs.select("digest").distinct(), "digest", "left_anti")


def bundle_verify(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """(record_id, files, missing, bad, ok) for bundles (record_id, path, digest) against blobs (digest, content)."""
    stored = verified_blobs(blobs).groupBy("digest").agg(F.bool_and("ok").alias("ok"))
    joined = manifest.join(stored, "digest", "left")
    counts = joined.groupBy("record_id").agg(F.count("*").alias("files"), F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if(~F.col("ok")).alias("bad"))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("bad") == 0))


def bundle_problems(manifest: DataFrame, blobs: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, problem) of records (record_id, artifact_hash) whose bundle does not verify: its tree has another digest
    than the record sealed, or blobs are missing or altered. A record without a bundle has no tree."""
    trees = tree_digest(manifest, "record_id").select("record_id", "digest")
    checked = bundle_verify(manifest, blobs).select("record_id", "missing", "bad")
    joined = records.select("record_id", "artifact_hash").join(trees, "record_id", "left").join(checked, "record_id", "left")
    found = F.array(
        F.when(F.col("digest").isNull(), F.lit("no tree")).when(F.col("digest") != F.col("artifact_hash"), F.lit("another tree")),
        F.when(F.col("missing") > 0, F.lit("blobs missing")), F.when(F.col("bad") > 0, F.lit("blobs altered")),
    )
    return joined.select("record_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def staged_snapshots(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """(input_id, kind, digest, size, file_count) of staged inputs (input_id, is_dir) and their files (input_id, path, digest,
    size): a file's snapshot is that of its bytes, a folder's that of its tree; an empty folder has the empty tree."""
    both = inputs.join(files, "input_id", "left")
    one = both.where("not is_dir").select("input_id", F.lit("file").alias("kind"), "digest", "size", F.lit(1).cast("long").alias("file_count"))
    trees = both.where("is_dir and path is not null").groupBy("input_id").agg(F.sha2(tree_text(F.col("path"), F.col("digest")), 256).alias("digest"), F.sum("size").alias("size"), F.count("*").alias("file_count"))
    none = both.where("is_dir and path is null").select("input_id", F.sha2(F.lit(""), 256).alias("digest"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("file_count"))
    folders = trees.unionByName(none).select("input_id", F.lit("tree").alias("kind"), "digest", "size", "file_count")
    return one.where("digest is not null").unionByName(folders)


def snapshot_totals(manifest: DataFrame, blobs: DataFrame, *keys: str) -> DataFrame:
    """(keys, size, file_count) of trees by the blobs they name."""
    sizes = blobs.select("digest", "size").dropDuplicates(["digest"])
    return manifest.join(sizes, "digest").groupBy(*keys).agg(F.sum("size").alias("size"), F.count("*").alias("file_count"))


def output_limits(files: DataFrame, max_bytes: int, max_files: int) -> DataFrame:
    """(record_id, kept, over): files of each run in order of path until a limit is passed; over: output_limit or null."""
    run = Window.partitionBy("record_id").orderBy("path")
    counted = files.withColumns({"n": F.row_number().over(run), "total": F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))})
    inside = (F.col("n") <= max_files) & (F.col("total") <= max_bytes)
    return counted.groupBy("record_id").agg(F.count_if(inside).alias("kept"), F.max(F.when(~inside, F.lit("output_limit"))).alias("over"))


def markdown_path(manifest: DataFrame, parser_outputs: DataFrame, default: str = "document.md") -> DataFrame:
    """(record_id, path) of each bundle's Markdown: what its parser's manifest (record_id, body) names, else the default;
    path is null where that file is not in the bundle."""
    named = parser_outputs.select("record_id", F.get_json_object("body", "$.outputs.markdown").alias("named"))
    wanted = manifest.select("record_id").distinct().join(named, "record_id", "left").select("record_id", F.coalesce("named", F.lit(default)).alias("wanted"))
    here = manifest.select("record_id", F.col("path").alias("wanted"), F.col("path"))
    return wanted.join(here, ["record_id", "wanted"], "left").select("record_id", "path")
