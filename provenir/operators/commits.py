"""Appends as events: rules checked first, then one writer adds a batch to the chain; tables are folds of the chain.

Weaker than a database's transactions: two writers at once are not kept apart. Every append is a batch whose violations
query must be empty, and the chain shows afterwards whether two batches were written on the same head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions.canon import canonical_json, canonical_object, quote_json
from provenir.operators import campaign, delivery
from provenir.operators import chain as chains
from provenir.sources.files import exists

TARGET = "target_kind"


class Refused(ValueError):
    """A batch that breaks a rule; nothing of it was written."""


def record_body(record: DataFrame, with_state: bool = False) -> DataFrame:
    """record with body: what its creation commits to, in canonical JSON."""
    text = lambda c: quote_json(F.col(c))
    parser = F.when(F.col("parser_name").isNotNull(), canonical_object({"name": text("parser_name"), "version": text("parser_version")}))
    body = {"run_id": text("run_id"), "artifact_hash": text("artifact_hash"), "source_hash": text("source_hash"), "source_kind": text("source_kind"), "parser": parser, "backend": text("backend"), "run_conditions": canonical_json(F.col("run_conditions"))}
    if "parser_config" in record.columns:
        body |= {"parser_config": canonical_json(F.col("parser_config"))}
    if with_state:
        body |= {"state": text("state")}
    return record.withColumn("body", canonical_object(body))


def creation_problems(requests: DataFrame, records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(run_id, problem) of requests (run_id, artifacts, source_hash, source_kind, source_id) that may not become records."""
    known = snapshots.select(F.col("digest").alias("source_hash"), F.col("kind").alias("source_kind")).distinct().withColumn("archived", F.lit(True))
    taken = records.select("run_id").distinct().withColumn("taken", F.lit(True))
    twice = requests.groupBy("run_id").agg(F.count("*").alias("n"))
    joined = requests.join(known, ["source_hash", "source_kind"], "left").join(taken, "run_id", "left").join(twice, "run_id")
    problem = (
        F.when(F.col("artifacts") == 0, "no artifacts").when(F.col("taken") | (F.col("n") > 1), "run has a record")
        .when(F.col("source_hash").isNotNull() & F.col("archived").isNull(), "snapshot not archived").when(F.col("source_id").isNotNull() & F.col("source_hash").isNull(), "source without snapshot")
    )
    return joined.select("run_id", problem.alias("problem")).where("problem is not null")


def extend(head: tuple[int, str], events: DataFrame) -> DataFrame:
    """Chain rows that follow a head (seq, hash) for events (ord, kind, subject, body, at) of one chain."""
    seq, digest = head
    return chains.build_chain(events.withColumn("chain", F.lit("ledger")), first=seq, prev=digest).drop("chain")


def append(spark: SparkSession, log: str, events: DataFrame, violations: DataFrame | None = None, create: bool = False) -> tuple[int, str]:
    """Add events to the chain at log (Parquet) unless violations has rows; returns the new head (seq, hash). A chain is begun
    only where create says so: a mistyped path must not begin a second one."""
    if violations is not None and (bad := violations.limit(5).collect()):
        raise Refused("; ".join(str(r) for r in bad))
    last = spark.read.parquet(log).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).first() if exists(spark, log) else None
    if last is None and not create:
        raise FileNotFoundError(f"no chain at {log}")
    head = (0, "0" * 64) if last is None or last["seq"] is None else (last["seq"], last["hash"])
    extend(head, events).write.mode("append").parquet(log)
    now = spark.read.parquet(log).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).first()
    return now["seq"], now["hash"]


def transition_events(records: DataFrame, kind: str, reason: str | None = None) -> DataFrame:
    """Events (ord, kind, subject, body, at) that move records (record_id, at) to another state, in order of record_id."""
    body = canonical_object({"reason": F.lit(None).cast("string") if reason is None else quote_json(F.lit(reason))})
    # A chain takes events of one place by kind and subject, so no number is given to each.
    return records.select(F.lit(1).cast("long").alias("ord"), F.lit(kind).alias("kind"), F.col("record_id").alias("subject"), body.alias("body"), F.col("at"))


def drifted(plan: DataFrame) -> DataFrame:
    """Records that a validation plan finds no longer intact, with the reason for which they are invalidated."""
    return plan.where(F.col("status").isin("drift", "missing")).select("record_id", F.when(F.col("status") == "drift", "artifact_drift").otherwise("artifact_missing").alias("reason"))


def diverged(replays: DataFrame) -> DataFrame:
    """Records whose latest replay diverged."""
    last = replays.groupBy("record_id").agg(F.max_by("outcome", F.struct("replayed_at", "replay_id")).alias("outcome"))
    return last.where("outcome = 'diverged'").select("record_id")


def open_deliveries(wanted: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Of wanted (record_id, target_kind, target), those that have no delivery yet; each once."""
    keys = ["record_id", TARGET, "target"]
    return wanted.dropDuplicates(keys).join(deliveries, keys, "left_anti")


def dispatchable(records: DataFrame, bundles: DataFrame, deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """(dispatch_id, verdict): ready, not sealed, bundle broken, or already delivered; checked in this order."""
    state = records.select("record_id", "state")
    whole = bundles.select("record_id", F.col("ok").alias("whole"))
    joined = deliveries.join(state, "record_id", "left").join(whole, "record_id", "left").join(delivery.status(deliveries, events), "dispatch_id")
    verdict = F.when(~F.col("state").eqNullSafe(F.lit("sealed")), "not sealed").when(~F.coalesce("whole", F.lit(False)), "bundle broken").when(F.col("status") == "delivered", "already delivered").otherwise("ready")
    return joined.select("dispatch_id", verdict.alias("verdict"))


def history(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """(dispatch_id, events): each delivery's events in order, in one join."""
    logs = events.groupBy("dispatch_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event", "attempt_id"))).alias("events"))
    return deliveries.select("dispatch_id").join(logs, "dispatch_id", "left")


def signoffs(events: DataFrame) -> DataFrame:
    """Sign-offs in the chain, oldest first."""
    signed = events.where("kind = 'verification.signed_off'")
    return signed.select("seq", F.get_json_object("body", "$.report").alias("report"), F.get_json_object("body", "$.by").alias("by")).orderBy("seq")


def sign_off(spark: SparkSession, log: str, report_head: tuple[int, str], signed: DataFrame, stale: DataFrame) -> tuple[int, str]:
    """Append sign-offs (ord, subject, body, at) to the chain, which must hold the report's head still, and none of whose
    signed records may be stale (rows of campaign.stale_signoffs)."""
    chain = spark.read.parquet(log).select("seq", "hash")
    head = spark.createDataFrame([("report", *report_head)], "signoff_id string, head_seq long, head_hash string")
    lost = campaign.lost_heads(head, chain).select(F.col("problem"))
    return append(spark, log, signed.withColumn("kind", F.lit("verification.signed_off")), lost.unionByName(stale.select("problem")))


def append_replays(spark: SparkSession, table: str, replays: DataFrame) -> None:
    """Add replays to the log (Parquet at table); those whose replay_id is there already are left out, so that a repeated append
    adds nothing. One writer at a time."""
    new = replays.dropDuplicates(["replay_id"])
    if exists(spark, table):
        new = new.join(spark.read.parquet(table).select("replay_id"), "replay_id", "left_anti").select(*replays.columns)
    new.write.mode("append").parquet(table)


def encode_target(kind: Column, fields: dict[str, Column]) -> Column:
    """A delivery target as text: its kind and its fields in canonical JSON; null fields are stated as null."""
    return F.concat(kind, F.lit(":"), canonical_object({k: quote_json(v) for k, v in fields.items()}))


def dispatch_events(verdicts: DataFrame, violations: DataFrame, payloads: DataFrame, written: DataFrame, states: DataFrame, at: Column) -> DataFrame:
    """(dispatch_id, step, event, detail, at): what a dispatch writes to the log, in order of step, for deliveries that are ready.

    A payload that breaks a rule gets a failure without intent; any other an intent with its digest, then a receipt or the
    target's error; and a removal intent where the record was invalidated meanwhile. verdicts: dispatch_id, record_id,
    verdict. violations: record_id, violation. payloads: record_id, digest. written: dispatch_id, error. states: record_id, state."""
    joined = verdicts.where("verdict = 'ready'").join(violations.select("record_id", "violation"), "record_id", "left").join(payloads.select("record_id", "digest"), "record_id", "left")
    joined = joined.join(written.select("dispatch_id", F.col("error"), F.lit(True).alias("tried")), "dispatch_id", "left").join(states.select("record_id", "state"), "record_id", "left")
    step = lambda n, event, detail: F.struct(F.lit(n).alias("step"), F.lit(event).alias("event"), detail.cast("string").alias("detail"))
    bad, sent, ok = F.col("violation").isNotNull(), F.col("tried").isNotNull(), F.col("error").isNull()
    steps = F.array(
        F.when(bad, step(1, "failure", F.col("violation"))), F.when(~bad, step(2, "intent", F.col("digest"))), F.when(~bad & sent & ok, step(3, "receipt", F.lit(None))),
        F.when(~bad & sent & ~ok, step(4, "failure", F.col("error"))), F.when(~bad & sent & ok & (F.col("state") == "invalidated"), step(5, "removal_intent", F.lit(None))),
    )
    return joined.select("dispatch_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s")).select("dispatch_id", "s.*", at.alias("at"))


def removal_events(removing: DataFrame, removed: DataFrame, at: Column) -> DataFrame:
    """(dispatch_id, event, detail, at): the outcome of each removal intent (dispatch_id): a receipt or the target's error
    (removed: dispatch_id, error); none where the target has not answered."""
    joined = removing.select("dispatch_id").distinct().join(removed.select("dispatch_id", "error"), "dispatch_id")
    return joined.select("dispatch_id", F.when(F.col("error").isNull(), "removal_receipt").otherwise("removal_failure").alias("event"), F.col("error").alias("detail"), at.alias("at"))


def foreach_target(rows: DataFrame, write, size: int = 1000) -> None:
    """Hand each partition's deliveries to a writer (rows in, nothing back), size at a time; dispatch_id is the key that makes
    it repeatable."""
    from itertools import islice

    def send(part) -> None:
        rows = iter(part)
        while batch := list(islice(rows, size)):
            write(batch)

    rows.foreachPartition(send)
