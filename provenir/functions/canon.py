"""Canonical encodings as column expressions: JSON text, digests, percent-encoding, token counts, tolerances."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of record schemas and references; part of the wire format, so a parameter everywhere.
PREFIX = "provenir"
GENESIS = "0" * 64
_NAMED = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def quote_json(text: Column) -> Column:
    """A JSON string of a text, as the canonical form writes it: UTF-8 unescaped, control characters in lower-case hex."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = out
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_NAMED.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), out).otherwise(plain), F.lit('"'))


def canonical_object(fields: Mapping[str, Column]) -> Column:
    """A fixed-shape canonical JSON object of columns that hold JSON text; keys sorted by code point; null: null."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_text(value: str | None) -> str | None:
    """Canonical form of any JSON text; None for what is no JSON or holds a number that JSON can't."""
    try:
        return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def canonical_json(text: Column) -> Column:
    """Canonical form of a column of arbitrary JSON. Arbitrary depth and float text need Python; batches go by Arrow."""

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        return values.map(canonical_text)

    return canonical(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def source_id(locator: Column, prefix: str = PREFIX) -> Column:
    """SHA-256 of the canonical source record; null for an empty locator."""
    body = canonical_object({"locator": quote_json(locator), "schema": F.lit(f'"{prefix}.source"'), "schema_version": F.lit("1")})
    return F.when(locator != "", sha256(body))


def snapshot_record(kind: Column, digest: Column, size: Column, files: Column, prefix: str = PREFIX) -> Column:
    """Canonical snapshot record; null where a file is not one file, a count is negative or the digest is none."""
    ok = kind.isin("file", "tree") & is_digest(digest) & (size >= 0) & (files >= 0) & ((kind != "file") | (files == 1))
    body = {"schema": F.lit(f'"{prefix}.snapshot"'), "schema_version": F.lit("1"), "kind": quote_json(kind), "digest": quote_json(digest), "size": size.cast("string"), "file_count": files.cast("string")}
    return F.when(ok, canonical_object(body))


def event_hash(seq: Column, kind: Column, subject: Column, body: Column, at: Column, prev: Column) -> Column:
    """Hash of a chain event; its body is a text within the hashed object."""
    return sha256(canonical_object({"at": quote_json(at), "body": quote_json(body), "kind": quote_json(kind), "prev": quote_json(prev), "seq": seq.cast("string"), "subject": quote_json(subject)}))


def percent_encode(text: Column, slash: bool = True) -> Column:
    """RFC 3986 percent-encoding; a slash stays unless told otherwise."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if slash else out


def token_count(text: Column) -> Column:
    """Number of runs of non-white-space, white space as Unicode and the separators U+001C to U+001F have it."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")).cast("long")


def json_pointer(*keys: Column) -> Column:
    """RFC 6901 pointer of keys."""
    escaped = [F.concat(F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for k in keys]
    return F.concat(*escaped) if escaped else F.lit("")


def is_close(a: Column, b: Column, rel: float = 0.0, abs_: float = 0.0) -> Column:
    """|a - b| <= max(rel * max(|a|, |b|), abs); equal infinities are close, other infinities and NaN are not."""
    if rel < 0 or abs_ < 0:
        raise ValueError("tolerances are not negative")
    bad = F.isnan(a) | F.isnan(b)
    inf = F.abs(a).isin(float("inf")) | F.abs(b).isin(float("inf"))
    return F.when(bad, False).when(inf, a == b).otherwise(F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_)))


def memory_limit_ok(text: Column) -> Column:
    """A number above 0 and an optional unit, as container engines read it."""
    number = F.regexp_extract(text, r"(?i)^(\d+(?:\.\d+)?) ?[kmgtp]?i?b?\z", 1)
    return F.coalesce((number != "") & (number.try_cast("double") > 0), F.lit(False))


def strict_problem(text: Column, schema: str, fields: tuple[str, ...], version: int = 1) -> Column:
    """Why a text is not the canonical form of a record of a schema, or null: not an object, schema, version, fields, form."""
    keys = F.array_sort(F.json_object_keys(text))
    wanted = F.array(*[F.lit(k) for k in sorted({*fields, "schema", "schema_version"})])
    got = lambda k: F.get_json_object(text, f"$.{k}")
    form = canonical_json(text)
    return (
        F.when(form.isNull() | ~F.startswith(F.ltrim(text), F.lit("{")), "not an object").when(~got("schema").eqNullSafe(F.lit(schema)), "schema")
        .when(~got("schema_version").eqNullSafe(F.lit(str(version))), "version").when(keys != wanted, "fields").when(form != text, "form")
    )


def config_digest(config: Column) -> Column:
    """SHA-256 of a configuration's canonical JSON."""
    return sha256(canonical_json(config))
