"""Markdown as anchored units: blocks as byte ranges, kinds, sections; anchors resolved and checked against bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The syntax of fences, headings, lists and tables.
FENCE, ATX, SETEXT = r"^ {0,3}(`{3,}|~{3,})", r"^ {0,3}(#{1,6})(?:[ \t]|$)", r"^ {0,3}(=+|-+)[ \t]*$"
LIST, TABLE = r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]", r"(?i)^[ \t]*(?:\||<table\b)"
_fence, _atx, _setext, _list = (re.compile(x.encode()) for x in (FENCE, ATX, SETEXT, LIST))


def blocks_of(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of a document's blocks. Lines are classed first, then grouped: blank lines part blocks, an ATX heading
    and a fenced block stand alone (a fence runs to its closing one or the end), and an underline below the single first
    line of a paragraph, unless that is a list item, makes a heading of the two."""
    lines, at = [], 0
    for raw in data.splitlines(keepends=True):
        body = raw.rstrip(b"\r\n")
        lines.append((at, at + len(body), body))
        at += len(raw)
    out: list[tuple[int, int]] = []
    i, n = 0, len(lines)
    while i < n:
        start, end, body = lines[i]
        opened = _fence.match(body)
        if not body.strip():
            i += 1
        elif opened:
            mark, j = opened[1], i + 1
            while j < n:
                closing = _fence.match(lines[j][2])
                if closing and closing[1][:1] == mark[:1] and len(closing[1]) >= len(mark) and not lines[j][2][closing.end() :].strip():
                    break
                j += 1
            last = min(j, n - 1)
            out.append((start, lines[last][1]))
            i = last + 1
        elif _atx.match(body):
            out.append((start, end))
            i += 1
        elif i + 1 < n and _setext.match(lines[i + 1][2]) and not _list.match(body) and not _fence.match(lines[i + 1][2]):
            out.append((start, lines[i + 1][1]))
            i += 2
        else:
            j = i + 1
            while j < n and lines[j][2].strip() and not _fence.match(lines[j][2]) and not _atx.match(lines[j][2]):
                j += 1
            out.append((start, lines[j - 1][1]))
            i = j
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """(key, ord, start, end, block) of documents (key, content binary); block is the range's bytes. Finding blocks is
    sequential within a document, so it is a scan in Python, by Arrow batches; documents run in parallel."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, c[a:b]) for k, c in zip(pdf["key"], map(bytes, pdf["content"])) for i, (a, b) in enumerate(blocks_of(c))]
            yield pd.DataFrame(rows, columns=["key", "ord", "start", "end", "block"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "content").mapInPandas(scan, f"key {kind}, ord int, start long, end long, block binary")


def with_kind(units: DataFrame) -> DataFrame:
    """units (text) with kind and level; the order of tests is ATX, setext, fence, table, list, formula, figure."""
    text = F.col("text")
    lines = F.split(text, r"\r\n|\n|\r")
    first, second = F.get(lines, 0), F.get(lines, 1)
    atx = F.regexp_extract(first, ATX.replace("$", r"\z"), 1)
    under = F.regexp_extract(second, SETEXT.replace("$", r"\z"), 1)
    setext = (F.size(lines) == 2) & (under != "") & ~first.rlike(LIST)
    stripped = F.regexp_replace(text, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z", "")
    kind = (
        F.when(atx != "", "heading").when(setext, "heading").when(first.rlike(FENCE), "code").when(first.rlike(TABLE), "table").when(first.rlike(LIST), "list")
        .when(F.startswith(stripped, F.lit("$$")), "formula").when(F.startswith(stripped, F.lit("![")) & ~F.contains(stripped, F.lit("\n")), "figure").otherwise("paragraph")
    )
    level = F.when(atx != "", F.length(atx)).when(setext, F.when(F.startswith(under, F.lit("=")), 1).otherwise(2))
    return units.withColumns({"kind": kind, "level": level})


def with_sections(units: DataFrame, key: str = "key") -> DataFrame:
    """units (key, ord, kind, level) with unit_id and parent: the nearest heading before, of a lesser level if the unit is
    a heading itself. Six running windows over one partitioning, no stack."""
    run = Window.partitionBy(key).orderBy("ord")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    numbered = units.withColumn("unit_id", F.format_string("u%06d", F.row_number().over(run)))
    above = {f"_h{n}": F.last(F.when(F.col("level") < n, F.struct("ord", "unit_id")), ignorenulls=True).over(before) for n in range(2, 8)}
    opened = numbered.withColumns(above)
    parent = F.col("_h7.unit_id")
    for n in range(6, 0, -1):
        parent = F.when((F.col("kind") == "heading") & (F.col("level") == n), F.col(f"_h{n}.unit_id") if n > 1 else F.lit(None)).otherwise(parent)
    return opened.withColumn("parent", parent).drop(*above)


def normalise(docs: DataFrame) -> DataFrame:
    """Units (key, unit_id, ord, kind, level, parent, start, end, text, error) of documents. A document with a block that is
    not UTF-8 has no units but one row with an error, so that no unit gets another's number."""
    per = Window.partitionBy("key").orderBy("ord")
    whole = per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = blocks(docs).withColumn("valid", F.is_valid_utf8("block")).withColumns({"sound": F.min("valid").over(whole), "nth": F.row_number().over(per)})
    text = F.when(F.col("sound"), F.decode(F.when(F.col("valid"), F.col("block")), "UTF-8"))
    kept = found.where("sound or nth = 1").withColumn("text", text).withColumn("error", F.when(~F.col("sound"), F.lit("not UTF-8"))).drop("block", "valid", "sound", "nth")
    units = with_sections(with_kind(kept))
    failed = F.col("error").isNotNull()
    return units.withColumns({c: F.when(~failed, F.col(c)) for c in ("unit_id", "ord", "kind", "level", "parent", "start", "end")})


def resolve(units: DataFrame, manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """units (record_id, unit_id, artifact, digest, start, end, text) with resolved and problem: each anchor's bytes, read
    from the blob of its digest if that is in the record's bundle and verifies."""
    listed = manifest.select("record_id", F.col("path").alias("artifact"), F.col("digest").alias("listed"))
    stored = blobs.select("digest", F.col("content").cast("binary").alias("content"), (F.sha2(F.col("content").cast("binary"), 256) == F.col("digest")).alias("good"))
    joined = units.join(listed, ["record_id", "artifact"], "left").join(stored, "digest", "left")
    piece = F.substring(F.col("content"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    cut = joined.withColumn("piece", piece)
    text = F.when(F.is_valid_utf8("piece"), F.decode(F.when(F.is_valid_utf8("piece"), F.col("piece")), "UTF-8"))
    problem = (
        F.when(F.col("listed").isNull(), "not in the bundle").when(F.col("listed") != F.col("digest"), "digest differs").when(F.col("good").isNull(), "no blob")
        .when(~F.col("good"), "blob altered").when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.octet_length("content")), "out of range")
        .when(~F.is_valid_utf8("piece"), "not UTF-8").when(text != F.col("text"), "text differs")
    )
    return cut.select(*units.columns, F.when(problem.isNull() | (problem == "text differs"), text).alias("resolved"), problem.alias("problem"))


def header_problems(extractions: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, problem) of extractions whose head does not fit the record that they are held against: five checks.

    extractions: record_id (the record they are held against), of_record, artifact_hash, source_hash, parser, normaliser (as
    they state it). records: record_id, artifact_hash, source_hash, parser_name, parser_version."""
    own = F.concat_ws("@", "parser_name", "parser_version")
    real = records.select("record_id", F.col("artifact_hash").alias("r_artifact"), F.col("source_hash").alias("r_source"), F.when(F.col("parser_name").isNotNull(), own).alias("r_parser"), normaliser(F.col("parser_name")).alias("r_normaliser"), F.lit(True).alias("known"))
    joined = extractions.join(real, "record_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    checks = {
        "another record": differs("of_record", "record_id"), "another output": differs("artifact_hash", "r_artifact"), "another source": differs("source_hash", "r_source"),
        "another parser": differs("parser", "r_parser"), "no normaliser": F.col("r_normaliser").isNull(), "another normaliser": F.col("r_normaliser").isNotNull() & differs("normaliser", "r_normaliser"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return joined.select("record_id", F.explode(F.when(F.col("known").isNull(), F.array(F.lit("no record"))).otherwise(found)).alias("problem"))


def verify_extractions(extractions: DataFrame, records: DataFrame, units: DataFrame, manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """(record_id, unit_id, problem): problems of heads, and where a head has none, those of its units' anchors."""
    heads = header_problems(extractions, records)
    sound = extractions.select("record_id").join(heads.select("record_id").distinct(), "record_id", "left_anti")
    below = resolve(units.join(sound, "record_id", "left_semi"), manifest, blobs).where("problem is not null")
    return heads.select("record_id", F.lit(None).cast("string").alias("unit_id"), "problem").unionByName(below.select("record_id", "unit_id", "problem"))


def extraction_problems(units: DataFrame) -> DataFrame:
    """(record_id, unit_id, problem) of units that break the rules of an extraction: ids once, ord from 0 without gaps,
    known kinds, level with headings only, a parent that stands earlier, one kind of anchor."""
    kinds = ("heading", "paragraph", "list", "table", "code", "formula", "figure", "caption", "message", "other")
    per = Window.partitionBy("record_id")
    placed = units.withColumns({"n": F.count("*").over(Window.partitionBy("record_id", "unit_id")), "place": F.row_number().over(per.orderBy("ord")) - 1})
    above = units.select("record_id", F.col("unit_id").alias("parent"), F.col("ord").alias("parent_ord")).dropDuplicates(["record_id", "parent"])
    joined = placed.join(above, ["record_id", "parent"], "left")
    checks = {
        "id repeated": F.col("n") > 1, "order": F.col("ord") != F.col("place"), "kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)),
        "level": F.col("level").isNotNull() & ((F.col("kind") != "heading") | (F.col("level") < 1)),
        "parent": F.col("parent").isNotNull() & ~F.coalesce(F.col("parent_ord") < F.col("ord"), F.lit(False)),
        "range": F.col("start").isNotNull() & ((F.col("start") < 0) | (F.col("end") < F.col("start"))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return joined.select("record_id", "unit_id", F.explode(found).alias("problem"))


def pointer_value(document: Column, pointer: Column) -> Column:
    """The value, as JSON text, that an RFC 6901 pointer names in a JSON document; null if it names none."""
    import json

    @F.pandas_udf("string")
    def resolve_pointer(documents: pd.Series, pointers: pd.Series) -> pd.Series:
        def one(text: str | None, path: str | None) -> str | None:
            try:
                value = json.loads(text)
                if path and not path.startswith("/"):
                    return None
                for key in [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]:
                    if isinstance(value, list):
                        if not re.fullmatch("0|[1-9][0-9]*", key):
                            return None
                        value = value[int(key)]
                    else:
                        value = value[key]
                return json.dumps(value, ensure_ascii=False)
            except (TypeError, ValueError, KeyError, IndexError, AttributeError):
                return None

        return pd.Series([one(a, b) for a, b in zip(documents, pointers)], dtype="object")

    return resolve_pointer(document, pointer)


def chunks(units: DataFrame) -> DataFrame:
    """Delivery chunks (record_id, chunk_id, ord, content, content_hash, token_count, anchor) of units that resolve."""
    from provenir.functions.canon import sha256, token_count
    from provenir.functions.refs import anchor_ref

    none = F.lit(None).cast("string")
    anchor = anchor_ref(F.col("record_id"), F.col("artifact_hash"), F.col("artifact"), F.col("digest"), F.col("start"), F.col("end"), none, none)
    return units.select("record_id", F.concat("record_id", F.lit(":"), "unit_id").alias("chunk_id"), "ord", F.col("text").alias("content"), sha256(F.col("text")).alias("content_hash"), token_count(F.col("text")).alias("token_count"), anchor.alias("anchor"))


#: Normalisers by parser: which make units of Markdown and which of conversations.
NORMALISERS = {"mineru": "markdown", "marker": "markdown", "docling": "markdown", "export-split": "conversation"}


def normaliser(parser_name: Column) -> Column:
    """The normaliser of a parser's output; null if there is none."""
    out = F.when(F.lit(False), F.lit(""))
    for name, kind in NORMALISERS.items():
        out = out.when(parser_name == name, kind)
    return out


#: What a message unit says of its message, where it is known.
ATTRIBUTES = ("conversation_id", "conversation_title", "node_id", "message_id", "role", "author_name", "recipient", "content_type", "create_time", "depth", "sibling_index", "sibling_count", "is_leaf", "on_current_branch")


def conversation_units(nodes: DataFrame) -> DataFrame:
    """Message units (record_id, unit_id, ord, kind, text, parent, pointer, attributes) of flattened conversations (record_id,
    node_id, ord, text; parent_node_id and any of ATTRIBUTES); nodes without text have none. parent is the unit of the nearest
    ancestor with text, the anchor a pointer to the message, and attributes a JSON object of those that are not null."""
    from provenir.functions.canon import json_pointer

    shown = nodes.where(F.coalesce(F.col("text"), F.lit("")) != "")
    run = Window.partitionBy("record_id").orderBy("ord")
    n = F.row_number().over(run)
    above = F.col("parent_node_id") if "parent_node_id" in nodes.columns else F.lit(None).cast("string")
    own = shown.withColumns({"unit_id": F.format_string("u%06d", n), "n": (n - 1), "above": above})
    parents = own.select("record_id", F.col("node_id").alias("above"), F.col("unit_id").alias("parent"))
    said = F.to_json(F.struct(*[F.col(c) for c in ATTRIBUTES if c in nodes.columns]))
    pointer = json_pointer(F.lit("mapping"), F.col("node_id"), F.lit("message"))
    rest = [F.col("digest")] if "digest" in nodes.columns else []
    return own.join(parents, ["record_id", "above"], "left").select("record_id", "unit_id", F.col("n").alias("ord"), F.lit("message").alias("kind"), "text", "parent", pointer.alias("pointer"), said.alias("attributes"), *rest)
