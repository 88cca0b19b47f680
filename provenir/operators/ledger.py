"""The run ledger: reads, states folded from events, validation, run conditions, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.canon import canonical_json, canonical_object, memory_limit_ok, quote_json

STATES = ("pending", "sealed", "failed", "invalidated")
#: States from which a transition is allowed.
ALLOWED = {"record.sealed": ("pending",), "record.failed": ("pending", "failed"), "record.invalidated": ("pending", "sealed")}
REACHED = {"record.sealed": "sealed", "record.failed": "failed", "record.invalidated": "invalidated"}
LISTING = ("created_at", "record_id")


def find(records: DataFrame, **equal: object) -> DataFrame:
    """Records whose columns have these values."""
    out = records
    for k, v in equal.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def by_parser(records: DataFrame, name: str, version: str | None = None, config: str | None = None, device: str | None = None) -> DataFrame:
    """Records of a parser; a device matches only records with conditions that state it."""
    out = records.where(F.col("parser_name") == name)
    if version is not None:
        out = out.where(F.col("parser_version") == version)
    if config is not None:
        out = out.where(F.col("parser_config") == config)
    if device is not None:
        out = out.where(F.get_json_object("run_conditions", "$.device") == device)
    return out


def views(records: DataFrame) -> dict[str, DataFrame]:
    """all, and three views that share its records out."""
    return {"all": records, "pending": records.where("state = 'pending'"), "sealed": records.where("state = 'sealed'"), "invalidated_or_failed": records.where(F.col("state").isin("invalidated", "failed"))}


def duplicate_runs(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1")


def fold_states(events: DataFrame) -> DataFrame:
    """(record_id, state) of records that were created or imported: the last record event after that says the state."""
    own = events.where(F.col("kind").isin("record.created", "record.imported", *REACHED))
    state = F.when(F.col("kind") == "record.created", "pending").when(F.col("kind") == "record.imported", F.get_json_object("body", "$.state"))
    for kind, reached in REACHED.items():
        state = state.when(F.col("kind") == kind, reached)
    begun = F.min(F.when(F.col("kind").isin("record.created", "record.imported"), F.col("seq"))).over(Window.partitionBy("subject"))
    after = own.withColumns({"state": state, "begun": begun}).where("seq >= begun")
    return after.groupBy(F.col("subject").alias("record_id")).agg(F.max_by("state", "seq").alias("state"))


#: What the chain and the ledger both say of a record.
RECORD_KEYS = ("artifact_hash", "parser", "parser_config", "run_conditions", "run_id", "source_hash", "state")


def fold_records(events: DataFrame) -> DataFrame:
    """(record_id, RECORD_KEYS): each record as the chain has it; parser, parser_config and run_conditions are canonical JSON."""
    begun = events.where(F.col("kind").isin("record.created", "record.imported"))
    first = begun.groupBy(F.col("subject").alias("record_id")).agg(F.min_by("body", "seq").alias("body"))
    said = lambda k: F.get_json_object("body", f"$.{k}")
    value = {k: canonical_json(said(k)) if k in ("parser", "parser_config", "run_conditions") else said(k) for k in RECORD_KEYS if k != "state"}
    return first.join(fold_states(events), "record_id").select("record_id", *[v.alias(k) for k, v in value.items()], "state")


def record_differences(events: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, problem) between the chain and the ledger's records: only on one side, a key that differs (RECORD_KEYS, in
    order), a column that is no JSON (nothing else is then said), or a manifest that does not have the artifact hash.

    records: record_id, run_id, artifact_hash, source_hash, parser_name, parser_version, parser_config, run_conditions,
    state, manifest (JSON object of digests by path)."""
    text = lambda c: quote_json(F.col(c))
    parser = F.when(F.col("parser_name").isNotNull(), canonical_object({"name": text("parser_name"), "version": text("parser_version")}))
    read = records.withColumns({"parser": parser, **{f"c_{c}": canonical_json(F.col(c)) for c in ("parser_config", "run_conditions")}})
    bad = F.coalesce(*[F.when(F.col(c).isNotNull() & F.col(f"c_{c}").isNull(), F.lit(True)) for c in ("parser_config", "run_conditions")], F.lit(False))
    entries = F.from_json("manifest", "map<string,string>")
    paths = F.array_sort(F.map_keys(entries))
    tree = F.array_join(F.transform(paths, lambda p: F.concat(p, F.lit(chr(0)), F.element_at(entries, p), F.lit(chr(0)))), "")
    read = read.withColumns({"malformed": bad | (F.col("manifest").isNotNull() & entries.isNull()), "tree": F.sha2(tree, 256)})
    actual = read.select("record_id", F.struct("artifact_hash", "parser", F.col("c_parser_config").alias("parser_config"), F.col("c_run_conditions").alias("run_conditions"), "run_id", "source_hash", "state").alias("a"), "malformed", "tree")
    both = fold_records(events).select("record_id", F.struct(*RECORD_KEYS).alias("e")).join(actual, "record_id", "full_outer")
    keys = [F.when(~F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")), F.lit(k)) for k in RECORD_KEYS]
    keys.append(F.when(F.col("tree") != F.col("a.artifact_hash"), F.lit("manifest")))
    differing = F.filter(F.array(*keys), lambda x: x.isNotNull())
    problems = F.when(F.col("a").isNull(), F.array(F.lit("only in chain"))).when(F.col("e").isNull(), F.array(F.lit("only in ledger"))).when(F.col("malformed"), F.array(F.lit("malformed column"))).otherwise(differing)
    return both.select("record_id", F.explode(problems).alias("problem"))


def canonical_conditions(conditions: Column) -> Column:
    """Run conditions (JSON object) in canonical form; null where they are no object or state a malformed memory limit."""
    limit = F.get_json_object(conditions, "$.memory")
    form = canonical_json(conditions)
    return F.when(F.startswith(form, F.lit("{")) & (limit.isNull() | memory_limit_ok(limit)), form)


def illegal_transitions(events: DataFrame) -> DataFrame:
    """(record_id, seq, kind, from_state) of transitions that the state before does not allow; illegal ones change nothing,
    so the state before is that of the last legal event, found from the kind of event alone: each kind has one outcome."""
    own = events.where(F.col("kind").isin("record.created", *REACHED)).select(F.col("subject").alias("record_id"), "seq", "kind")
    start = F.struct(F.lit(None).cast("string").alias("state"), F.array().cast("array<struct<seq:bigint,kind:string,from_state:string>>").alias("bad"))

    def step(done: Column, e: Column) -> Column:
        ok = F.when(e["kind"] == "record.created", done["state"].isNull())
        to = F.when(e["kind"] == "record.created", F.lit("pending"))
        for kind, allowed in ALLOWED.items():
            ok = ok.when(e["kind"] == kind, done["state"].isin(*allowed))
            to = to.when(e["kind"] == kind, F.lit(REACHED[kind]))
        ok = F.coalesce(ok, F.lit(False))
        bad = F.array(F.struct(e["seq"].alias("seq"), e["kind"].alias("kind"), done["state"].alias("from_state")))
        return F.struct(F.when(ok, to).otherwise(done["state"]).alias("state"), F.when(ok, done["bad"]).otherwise(F.concat(done["bad"], bad)).alias("bad"))

    # A record's own events are a handful.
    folded = own.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("log"))
    return folded.select("record_id", F.explode(F.aggregate("log", start, step, lambda x: x["bad"])).alias("b")).select("record_id", "b.*")


def validate(manifest: DataFrame, disk: DataFrame, blobs: DataFrame) -> DataFrame:
    """(record_id, path, status) of each file: ok on disk, drift, archived (only in the archive, verified) or missing.

    disk: record_id, path, digest, safe (a link or device is not, and counts as drift); blobs: digest, ok."""
    good = blobs.where("ok").select("digest").distinct().withColumn("stored", F.lit(True))
    there = disk.select("record_id", "path", F.col("digest").alias("now"), "safe")
    joined = manifest.join(there, ["record_id", "path"], "left").join(good, "digest", "left")
    status = F.when(F.col("safe").isNull(), F.when(F.col("stored"), "archived").otherwise("missing")).when(~F.col("safe") | ~F.col("now").eqNullSafe(F.col("digest")), "drift").otherwise("ok")
    return joined.select("record_id", "path", status.alias("status"))


def validation_plan(files: DataFrame) -> DataFrame:
    """(record_id, status, drifted, missing) with missing before drift before archived before ok."""
    has = lambda s: F.bool_or(F.col("status") == s)
    paths = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("path"))))
    status = F.when(has("missing"), "missing").when(has("drift"), "drift").when(has("archived"), "archived").otherwise("ok")
    return files.groupBy("record_id").agg(status.alias("status"), paths("drift").alias("drifted"), paths("missing").alias("missing"))


def condition_problems(runs: DataFrame) -> DataFrame:
    """(run_id, field, problem): limits a run states that its result did not apply or applied otherwise.

    runs: run_id, stated and applied (JSON objects of limits). Numbers compare by value; a stated gpu must be applied."""
    fields = ("cpus", "memory", "pids_limit", "timeout_seconds", "device")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object("stated", f"$.{f}").alias("want"), F.get_json_object("applied", f"$.{f}").alias("got")) for f in fields]))
    each = runs.select("run_id", pairs.alias("x")).select("run_id", "x.*").where("want is not null")
    same = F.coalesce(F.col("want").try_cast("double") == F.col("got").try_cast("double"), F.col("want") == F.col("got"))
    problem = F.when((F.col("field") == "memory") & ~memory_limit_ok(F.col("want")), "malformed").when(F.col("got").isNull(), "not reported").when(~same, "differs")
    return each.select("run_id", "field", problem.alias("problem")).where("problem is not null")


def run_refusals(runs: DataFrame) -> DataFrame:
    """runs (run_id, exit_code, timed_out, artifacts, input_sha256, snapshot_digest, claimed, measured) with refusal: why a
    run may not become a record, first reason first; null if it may."""
    claimed = F.col("claimed").isNotNull() & ~F.col("claimed").eqNullSafe(F.col("measured"))
    refusal = (
        F.when(F.col("timed_out") | (F.col("exit_code") != 0), "run failed").when(F.col("artifacts") == 0, "no artifacts")
        .when(F.col("input_sha256").isNotNull() & F.col("snapshot_digest").isNull(), "input not archived")
        .when(~F.col("input_sha256").eqNullSafe(F.col("snapshot_digest")), "input differs").when(claimed, "identity differs")
    )
    return runs.withColumn("refusal", refusal)


def migrate(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of the first schema (run_id, state, source_hash, bundle_ok) in the present one: committed is sealed where the
    bundle verifies, else invalidated; a source hash stays only if it is a snapshot of exactly one kind."""
    one = snapshots.groupBy(F.col("digest").alias("source_hash")).agg(F.count_distinct("kind").alias("kinds"), F.max("kind").alias("kind")).where("kinds = 1").select("source_hash", "kind")
    joined = rows.join(one, "source_hash", "left")
    state = F.when(F.col("state") == "committed", F.when(F.col("bundle_ok"), "sealed").otherwise("invalidated")).otherwise(F.col("state"))
    known = F.col("kind").isNotNull()
    return joined.select("run_id", state.alias("state"), F.when(known, F.col("source_hash")).alias("source_hash"), F.col("kind").alias("source_kind"), F.when(~known, F.col("source_hash")).alias("legacy_source_hash"))


def rebuilt(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows copied into a table of other columns (name: type): what it lacks is left out, what is new is null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def backfill_order(records: DataFrame, deliveries: DataFrame, delivery_events: DataFrame, replays: DataFrame) -> DataFrame:
    """(section, id, key): the order in which a ledger without a chain is imported. Sort by (section, key, id)."""
    parts = [
        records.select(F.lit(1).alias("section"), F.col("record_id").alias("id"), F.col("created_at").alias("key")),
        deliveries.select(F.lit(2), F.col("dispatch_id"), F.col("created_at")),
        delivery_events.select(F.lit(3), F.col("event_id").cast("string"), F.format_string("%020d", F.col("event_id"))),
        replays.select(F.lit(4), F.col("replay_id"), F.col("replayed_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("section", "key", "id")
