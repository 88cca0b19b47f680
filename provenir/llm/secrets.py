"""Incremental secret scanning over a blob ledger.

Every version of every path is addressed by its content (SHA-256). A ledger says which (blob, rule version) pairs have
been scanned and what was found; only unseen pairs are scanned, each blob once however many paths and versions share it,
and findings are joined back to all paths. Everything is DataFrame functions: a regular expression's matches come from
regexp_extract_all, and their places from the lengths of the pieces between them.

Defined results: a null text is the empty blob; repeated rows are scanned once and each gets the findings; an empty
table gives empty findings. Spans are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import carried, prefixed, prepare, quoted, salted_join, written


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; of these, those whose group is at least that long."""

    kind: str
    pattern: str
    group: int
    least: int


#: The kinds in the order in which they are listed at the same start.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULE_VERSION = "1"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of a rule's findings in a text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("skip"), F.transform(whole, F.length).alias("len"), F.transform(group, F.length).alias("held"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")

    def place(done: Column, m: Column) -> Column:
        start = done["at"] + m["skip"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + m["len"]).alias("end")))
        return F.struct((start + m["len"]).alias("at"), F.when(m["held"] >= rule.least, F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

    walked = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), place, lambda done: done["out"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of blobs (blob, text); findings in order of start, then rule."""
    each = [spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*each)).alias("findings"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for the blobs of versions (text) that ledger lacks under rule_version."""
    blobs = versions.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal blobs meet in the tasks that read them first, so a text of many copies is shuffled once a task.
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = unseen.join(seen.hint("merge"), "blob", "left_anti")
    return scan(unseen, rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(versions with blob and findings, ledger rows to append).

    versions: text and any others; a path and a commit, say. Its own columns named blob or findings are replaced. The new
    ledger rows are stored below the shared folder, so that both results read what was scanned once."""
    prepare(versions.sparkSession)
    new = written(update_ledger(versions.select("text"), ledger, rules, rule_version))
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version", "findings"))
    held = known.where(F.size("findings") > 0).select(F.col("blob").alias("key"), "findings")
    kept = versions.select(*prefixed(versions)).withColumn("key", F.sha2(F.coalesce("in_text", F.lit("")), 256))
    # A blob of very many paths is dealt to several tasks by what else a version says; held has only blobs with findings.
    rest = [quoted(f"in_{c}") for c in versions.columns if c.lower() != "text"]
    joined = salted_join(kept, held, "key", F.xxhash64(*rest) if rest else F.lit(0))
    found = F.coalesce("findings", F.array().cast(held.schema["findings"].dataType))
    return joined.select(*carried(versions, ("blob", "findings")), F.col("key").alias("blob"), found.alias("findings")), new


def as_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
