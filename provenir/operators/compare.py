"""Comparing outputs: structural JSON differences under tolerances, replay outcomes."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions.canon import is_close


@dataclass(frozen=True)
class Tolerance:
    rel: float = 0.0
    abs: float = 0.0

    def __post_init__(self) -> None:
        if self.rel < 0 or self.abs < 0:
            raise ValueError("tolerances are not negative")


@dataclass(frozen=True)
class JsonPolicy:
    """Which differences count: a float may move by the tolerance of the nearest enclosing key that has one, else by the
    default; keys in ignore are not looked at, at any depth; everything else must be equal, in type too."""

    default: Tolerance = Tolerance()
    ignore: frozenset[str] = frozenset()
    keys: Mapping[str, Tolerance] = field(default_factory=dict)

    def describe(self) -> str:
        rule = lambda t: {"abs_tol": t.abs, "rel_tol": t.rel}
        return json.dumps({"name": "provenir.json", "version": 1, **rule(self.default), "ignore_keys": sorted(self.ignore), "key_tolerances": {k: rule(t) for k, t in self.keys.items()}}, sort_keys=True, separators=(",", ":"))

    def findings(self, a: Any, b: Any, path: str = "") -> Iterator[tuple[str, str]]:
        """(path, finding) of two JSON values."""
        todo = [(a, b, path, self.default)]
        while todo:
            x, y, at, tol = todo.pop()
            if isinstance(x, dict) and isinstance(y, dict):
                mine, theirs = x.keys() - self.ignore, y.keys() - self.ignore
                yield from ((f"{at}/{k}", "on one side only") for k in sorted(mine ^ theirs))
                todo += [(x[k], y[k], f"{at}/{k}", self.keys.get(k, tol)) for k in sorted(mine & theirs, reverse=True)]
            elif isinstance(x, list) and isinstance(y, list):
                if len(x) != len(y):
                    yield at, f"lists of {len(x)} and {len(y)}"
                else:
                    todo += [(p, q, f"{at}[{i}]", tol) for i, (p, q) in reversed(list(enumerate(zip(x, y))))]
            elif isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool) and float in (type(x), type(y)):
                if not math.isclose(x, y, rel_tol=tol.rel, abs_tol=tol.abs):
                    yield at, f"{x!r} and {y!r} are too far apart"
            elif type(x) is not type(y) or x != y:
                yield at, f"{x!r} is not {y!r}"


#: For outputs of layout models: boxes may move by a point, scores a little.
LAYOUT_POLICY = JsonPolicy(Tolerance(1e-6, 1e-9), frozenset({"created_at", "duration"}), {"bbox": Tolerance(0.0, 1.0), "score": Tolerance(0.0, 0.01)})


def json_findings(pairs: DataFrame, policy: JsonPolicy) -> DataFrame:
    """(key, path, finding) of pairs (key, name, a, b: JSON text); equal texts are not parsed. Names in .jsonl compare line by
    line. A pair that is no JSON gives one finding."""

    def load(text: str, lines: bool) -> Any:
        return [json.loads(x) for x in text.splitlines() if x.strip()] if lines else json.loads(text)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, name, a, b in zip(pdf["key"], pdf["name"], pdf["a"], pdf["b"]):
                lines = str(name).endswith(".jsonl")
                try:
                    rows += [(key, p, f) for p, f in policy.findings(load(a, lines), load(b, lines))]
                except (ValueError, TypeError, RecursionError):  # also JSON nested too deeply for the parser
                    rows.append((key, "", "not comparable as JSON"))
            yield pd.DataFrame(rows, columns=["key", "path", "finding"])

    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("key", "name", "a", "b").mapInPandas(compare, f"key {kind}, path string, finding string")


def output_findings(recorded: DataFrame, replayed: DataFrame, blobs: DataFrame, policy: JsonPolicy) -> DataFrame:
    """(key, path, finding) of two sets of files (key, path, digest) under a policy, their contents in blobs (digest, content).

    Files on one side only are findings; equal digests match; .json and .jsonl files are compared by the policy, a finding's
    place following the file's path; any other file must be the same bytes. An output without findings is accepted."""
    a, b = (df.select("key", "path", F.col("digest").alias(name)) for df, name in ((recorded, "x"), (replayed, "y")))
    both = a.join(b, ["key", "path"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    json_file = F.col("path").rlike(r"\.jsonl?\z") & F.col("x").isNotNull() & F.col("y").isNotNull()
    plain = both.where(~json_file).select("key", "path", F.when(F.col("y").isNull(), "only recorded").when(F.col("x").isNull(), "only replayed").otherwise("other bytes").alias("finding"))
    stored = blobs.select("digest", F.col("content").cast("string").alias("content")).dropDuplicates(["digest"])
    left, right = (stored.select(F.col("digest").alias(d), F.col("content").alias(c)) for d, c in (("x", "a"), ("y", "b")))
    files = both.where(json_file).join(left, "x", "left").join(right, "y", "left")
    # One key for a file, so that findings come back with both.
    found = json_findings(files.select(F.to_json(F.struct("key", "path")).alias("key"), F.col("path").alias("name"), F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("-")).alias("b")), policy)
    at = F.from_json("key", F.lit(f"key {recorded.schema['key'].dataType.simpleString()}, path string"))
    return plain.unionByName(found.withColumn("at", at).select("at.key", F.concat("at.path", "path").alias("path"), "finding"))


def vectors_close(pairs: DataFrame, rel: float, abs_: float) -> DataFrame:
    """(key, compared, beyond, close) of pairs (key, a, b: array<double>); vectors of different length are not close."""
    off = F.size(F.filter(F.arrays_zip("a", "b"), lambda x: ~is_close(x["a"], x["b"], rel, abs_)))
    same = F.size("a") == F.size("b")
    return pairs.select("key", F.size("a").alias("compared"), F.when(same, off).alias("beyond"), (same & F.coalesce(off == 0, F.lit(False))).alias("close"))


def replay_outcomes(replays: DataFrame) -> DataFrame:
    """replays with outcome and reason, first rule first.

    Columns: state, parser_name, in_catalog, conditions_ok, deterministic, has_policy, module_ok, input_ok, config_ok,
    backend_ok, measured_ok, succeeded, differences, policy_accepts."""
    rules = {
        "no parser identity": F.col("parser_name").isNull(), "not in the catalog": ~F.col("in_catalog"), "conditions unusable": ~F.col("conditions_ok"),
        "not deterministic and no policy": ~F.col("deterministic") & ~F.col("has_policy"), "module differs": ~F.col("module_ok"), "input unavailable": ~F.col("input_ok"),
        "config can't be built": ~F.col("config_ok"), "no capable backend": ~F.col("backend_ok"), "measured digest differs": ~F.col("measured_ok"),
    }
    reason = F.when(~F.col("state").isin("sealed", "invalidated"), "refused")
    for why, when in rules.items():
        reason = reason.when(when, why)
    outcome = (
        F.when(F.col("reason") == "refused", "refused").when(F.col("reason").isNotNull(), "unreplayable").when(~F.col("succeeded"), "failed")
        .when((F.col("differences") == 0) & F.col("deterministic"), "reproduced").when(F.col("has_policy"), F.when(F.col("policy_accepts"), "equivalent").otherwise("diverged"))
        .otherwise("diverged")
    )
    return replays.withColumn("reason", reason).withColumn("outcome", outcome)


def input_name(kind: str, name: str) -> str:
    """A portable name of a replayed input: letters, digits, dot, dash and underscore, never hidden or empty."""
    safe = "".join(c if c.isascii() and (c.isalnum() or c in "._-") else "_" for c in name).lstrip(".")
    return safe or ("tree" if kind == "tree" else "input")


def replays_of(replays: DataFrame, record_id: str | None = None, outcome: str | None = None) -> DataFrame:
    """Replays of a record, with an outcome, or all, in order of (replayed_at, replay_id)."""
    out = replays
    for name, value in (("record_id", record_id), ("outcome", outcome)):
        out = out if value is None else out.where(F.col(name) == value)
    return out.orderBy("replayed_at", "replay_id")


def catalogue(specs: DataFrame) -> DataFrame:
    """Parsers (name, version, any others) that may be replayed; ValueError where one is listed twice."""
    twice = specs.groupBy("name", "version").agg(F.count("*").alias("n")).where("n > 1").orderBy("name", "version").limit(5).collect()
    if twice:
        raise ValueError("listed twice: " + ", ".join(f"{r['name']} {r['version']}" for r in twice))
    return specs


def in_catalogue(replays: DataFrame, specs: DataFrame) -> DataFrame:
    """replays (parser_name, parser_version) with in_catalog."""
    known = specs.select(F.col("name").alias("parser_name"), F.col("version").alias("parser_version")).distinct().withColumn("in_catalog", F.lit(True))
    return replays.drop("in_catalog").join(known, ["parser_name", "parser_version"], "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
