"""References that commit to content: formatting and strict parsing of six types, as column expressions.

A text is a reference only if it is in canonical form: parsing takes it apart, formats the parts again and compares.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenir.functions.canon import PREFIX, canonical_object, is_digest, percent_encode, quote_json, sha256

RECORD_ID = r"[A-Za-z0-9][A-Za-z0-9._-]*"
_HEX = "[0-9a-f]{64}"
_UINT = r"(?:0|[1-9]\d*)"


def _of(kind: str, *parts: Column | str, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(f"{prefix}:{kind}:"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def source_ref(source_id: Column) -> Column:
    return F.when(is_digest(source_id), _of("source", source_id))


def snapshot_ref(kind: Column, digest: Column) -> Column:
    return F.when(kind.isin("file", "tree") & is_digest(digest), _of("snapshot", kind, ":", digest))


def record_ref(record_id: Column, artifact_hash: Column) -> Column:
    return F.when(record_id.rlike(f"^{RECORD_ID}\\z") & is_digest(artifact_hash), _of("record", record_id, "@", artifact_hash))


def event_ref(seq: Column, digest: Column) -> Column:
    return F.when((seq >= 1) & is_digest(digest), _of("event", seq.cast("string"), "@", digest))


def observation_digest(record_id: Column, source_id: Column, kind: Column, digest: Column, observed_at: Column, prefix: str = PREFIX) -> Column:
    """Digest of the canonical statement that a record saw a source as a snapshot; a null source is stated as null."""
    snapshot = canonical_object({"kind": quote_json(kind), "digest": quote_json(digest)})
    body = {"schema": F.lit(f'"{prefix}.observation"'), "schema_version": F.lit("1"), "record_id": quote_json(record_id), "source_id": quote_json(source_id), "snapshot": snapshot, "observed_at": quote_json(observed_at)}
    return F.when(digest.isNotNull() & kind.isNotNull(), sha256(canonical_object(body)))


def observation_ref(record_id: Column, digest: Column) -> Column:
    return F.when(record_id.rlike(f"^{RECORD_ID}\\z") & is_digest(digest), _of("observation", record_id, "@", digest))


def anchor_ref(record_id: Column, artifact_hash: Column, artifact: Column, digest: Column, start: Column, end: Column, pointer: Column, render: Column) -> Column:
    """An anchor has a byte range or a pointer with its renderer, never both."""
    fragment = F.when(start.isNotNull() & pointer.isNull(), F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), end.cast("string"))).when(
        start.isNull() & pointer.isNotNull(), F.concat(F.lit("pointer="), percent_encode(pointer), F.lit("&render="), percent_encode(render, slash=False))
    )
    return _of("anchor", record_id, "@", artifact_hash, "/", percent_encode(artifact), "@", digest, "#", fragment)


def parse_ref(text: Column, prefix: str = PREFIX) -> Column:
    """struct<type, id, digest, artifact, artifact_digest, start, end, pointer, render> of a canonical reference, else null."""
    p = prefix.replace(".", r"\.")
    got = lambda pattern, group: F.regexp_extract(text, pattern, group)
    plain = rf"^{p}:(?:source:({_HEX})|snapshot:(file|tree):({_HEX})|(record|observation):({RECORD_ID})@({_HEX})|event:([1-9]\d*)@({_HEX}))\z"
    path = r"(?:[A-Za-z0-9_.~/-]|%[0-9A-F]{2})+"
    anchor = rf"^{p}:anchor:({RECORD_ID})@({_HEX})/({path})@({_HEX})#(?:bytes=({_UINT})-({_UINT})|pointer=((?:{path})?)&render=((?:[A-Za-z0-9_.~-]|%[0-9A-F]{{2}})+))\z"
    kind = F.regexp_extract(text, rf"^{p}:([a-z]+):", 1)
    unquote = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    nothing = F.lit(None).cast("string")
    number = lambda g: F.when(got(anchor, g) != "", got(anchor, g).try_cast("long"))
    ranged = number(5).isNotNull()
    simple = F.struct(
        kind.alias("type"),
        F.when(kind == "snapshot", got(plain, 2)).when(kind.isin("record", "observation"), got(plain, 5)).when(kind == "event", got(plain, 7)).alias("id"),
        F.when(kind == "source", got(plain, 1)).when(kind == "snapshot", got(plain, 3)).when(kind == "event", got(plain, 8)).otherwise(got(plain, 6)).alias("digest"),
        nothing.alias("artifact"), nothing.alias("artifact_digest"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), nothing.alias("pointer"), nothing.alias("render"),
    )
    anchored = F.struct(
        kind.alias("type"), got(anchor, 1).alias("id"), got(anchor, 2).alias("digest"), unquote(got(anchor, 3)).alias("artifact"), got(anchor, 4).alias("artifact_digest"),
        number(5).alias("start"), number(6).alias("end"), F.when(~ranged, unquote(got(anchor, 7))).alias("pointer"), F.when(~ranged, unquote(got(anchor, 8))).alias("render"),
    )
    again = anchor_ref(anchored["id"], anchored["digest"], anchored["artifact"], anchored["artifact_digest"], anchored["start"], anchored["end"], anchored["pointer"], anchored["render"])
    ok = text.rlike(anchor) & (again == text) & (~ranged | (number(6) >= number(5)))
    return F.when(text.rlike(plain), simple).when(F.coalesce(ok, F.lit(False)), anchored)
