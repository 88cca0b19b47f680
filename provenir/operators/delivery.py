"""Delivery logs: states folded from intents and receipts, payload digests, chunks and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.canon import canonical_object, quote_json, sha256, token_count

STATUS = {"intent": "intended", "receipt": "delivered", "failure": "failed", "removal_intent": "removing", "removal_receipt": "removed", "removal_failure": "removal_failed"}
WRITES = ("intent", "receipt", "failure")


def _mapped(event: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in STATUS.items():
        out = out.when(event == k, v)
    return out


def status(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """(dispatch_id, status) by the last event, not_attempted without one."""
    last = events.groupBy("dispatch_id").agg(F.max_by("event", "event_id").alias("event"))
    return deliveries.select("dispatch_id").join(last, "dispatch_id", "left").select("dispatch_id", F.coalesce(_mapped(F.col("event")), F.lit("not_attempted")).alias("status"))


def bound(events: DataFrame) -> DataFrame:
    """(dispatch_id, chunks_digest, planned) that the first intent binds; planned is 0 without one."""
    first = F.min_by(F.when(F.col("event") == "intent", F.struct("chunks_digest", "planned")), F.when(F.col("event") == "intent", F.col("event_id")))
    return events.groupBy("dispatch_id").agg(first.alias("f")).select("dispatch_id", "f.chunks_digest", F.coalesce("f.planned", F.lit(0)).alias("planned"))


def last_error(events: DataFrame) -> DataFrame:
    """(dispatch_id, error) of the latest failure or failed removal."""
    failed = F.col("event").isin("failure", "removal_failure")
    return events.where(failed).groupBy("dispatch_id").agg(F.max_by("error", "event_id").alias("error"))


def possibly_written(events: DataFrame) -> DataFrame:
    """(dispatch_id, possibly_written): whether the target may hold something, in closed form.

    True if, after the last removal receipt, a write succeeded or failed without saying that nothing was done; or an
    attempt's last write event is an intent; or the same of the events without an attempt, read one at a time; or one of
    those intents was followed by another, after the removal. The sequential fold over a log gives the same."""
    removed = F.coalesce(F.max(F.when(F.col("event") == "removal_receipt", F.col("event_id"))), F.lit(-1))
    wrote = F.max(F.when((F.col("event") == "receipt") | ((F.col("event") == "failure") & (F.col("done").isNull() | (F.col("done") != 0))), F.col("event_id")))
    whole = events.groupBy("dispatch_id").agg(removed.alias("removed"), wrote.alias("wrote"))
    written = events.where(F.col("event").isin(*WRITES))
    attempts = written.groupBy("dispatch_id", "attempt_id").agg(F.max_by("event", "event_id").alias("last"))
    open_ = attempts.groupBy("dispatch_id").agg(F.bool_or(F.col("last") == "intent").alias("open"))
    loose = written.where("attempt_id is null").groupBy("dispatch_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event"))).alias("log"))
    twice = F.filter("log", lambda x, i: (i > 0) & (x["event"] == "intent") & (F.get(F.col("log"), i - 1)["event"] == "intent"))
    again = loose.select("dispatch_id", F.array_max(F.transform(twice, lambda x: x["event_id"])).alias("again"))
    joined = whole.join(open_, "dispatch_id", "left").join(again, "dispatch_id", "left")
    later = lambda c: F.coalesce(F.col(c) > F.col("removed"), F.lit(False))
    return joined.select("dispatch_id", (later("wrote") | later("again") | F.coalesce("open", F.lit(False))).alias("possibly_written"))


def explain(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """(dispatch_id, explanation) in words, from the status, what may be written and the last error."""
    joined = status(deliveries, events).join(possibly_written(events), "dispatch_id", "left").join(last_error(events), "dispatch_id", "left")
    may = F.coalesce("possibly_written", F.lit(False))
    why = F.coalesce(F.concat(F.lit(": "), F.col("error")), F.lit(""))
    words = (
        F.when(F.col("status") == "not_attempted", "nothing was sent").when(F.col("status") == "delivered", "the target confirmed the write")
        .when(F.col("status") == "removed", F.when(may, "removed, but another attempt may have written").otherwise("removed from the target"))
        .when(F.col("status") == "failed", F.concat(F.when(may, "failed, and may have been written in part").otherwise("failed, nothing written"), why))
        .when(F.col("status") == "removal_failed", F.concat(F.lit("removal failed"), why)).when(F.col("status") == "removing", "removal has no outcome yet")
        .otherwise("the write has no outcome yet")
    )
    return joined.select("dispatch_id", words.alias("explanation"))


def retract_set(records: DataFrame, deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Deliveries of invalidated records that may hold something."""
    gone = records.where("state = 'invalidated'").select("record_id")
    may = possibly_written(events).where("possibly_written").select("dispatch_id")
    return deliveries.join(gone, "record_id", "left_semi").join(may, "dispatch_id", "left_semi")


def payload_conflicts(events: DataFrame) -> DataFrame:
    """Intents (dispatch_id, event_id) whose digest is not that of an earlier intent of the delivery."""
    intents = events.where("event = 'intent'").select("dispatch_id", "event_id", "chunks_digest")
    first = intents.groupBy("dispatch_id").agg(F.min_by(F.struct("chunks_digest"), "event_id").alias("f"))
    return intents.join(first, "dispatch_id").where(~F.col("chunks_digest").eqNullSafe(F.col("f.chunks_digest"))).select("dispatch_id", "event_id")


def make_chunks(texts: DataFrame) -> DataFrame:
    """texts (chunk_id, content, any others) with content_hash and token_count."""
    return texts.withColumns({"content_hash": sha256(F.col("content")), "token_count": token_count(F.col("content"))})


def payload_digest(chunks: DataFrame, version: str = "chunks-v2") -> DataFrame:
    """(record_id, digest) over a delivery's chunks in order (ord); metadata is canonical JSON text."""
    body = canonical_object({"chunk_id": quote_json(F.col("chunk_id")), "content_hash": quote_json(F.col("content_hash")), "metadata": F.col("metadata"), "token_count": F.col("token_count").cast("string")})
    listed = F.array_sort(F.collect_list(F.struct("ord", body.alias("body"))))
    joined = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["body"]), ","), F.lit("]"))
    return chunks.groupBy("record_id").agg(F.concat(F.lit(f"{version}:"), sha256(joined)).alias("digest"))


def chunk_violations(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, violation): the first rule that a record's chunks break, in order of chunks, then of rules."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("record_id", "chunk_id").orderBy("ord"))
    broken = (
        F.when(F.coalesce(F.col("chunk_id"), F.lit("")) == "", "empty id").when(F.col("nth") > 1, "duplicate id")
        .when(F.coalesce(F.col("content"), F.lit("")) == "", "empty content").when(F.coalesce(F.col("content_hash"), F.lit("")) == "", "empty hash")
        .when(F.col("content_hash") != sha256(F.col("content")), "wrong hash").when(F.col("token_count").isNull() | (F.col("token_count") < 0), "token count")
        .when(F.try_parse_json("metadata").isNull(), "metadata")
    )
    first = chunks.withColumn("nth", nth).withColumn("broken", broken).groupBy("record_id").agg(F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("ord"))).alias("violation"), F.count("*").alias("n"))
    joined = records.select("record_id").join(first, "record_id", "left")
    return joined.select("record_id", F.when(F.col("n").isNull(), "no chunks").otherwise(F.col("violation")).alias("violation")).where("violation is not null")


def results(events: DataFrame) -> DataFrame:
    """(dispatch_id, submitted, written, error) of each delivery's last outcome; written is null where it is unknown."""
    outcome = F.max_by(F.struct("event", "done", "error", "planned"), F.when(F.col("event").isin("receipt", "failure"), F.col("event_id")))
    out = events.groupBy("dispatch_id").agg(outcome.alias("o"), F.max(F.when(F.col("event").isin("receipt", "failure"), 1)).alias("any")).where("any = 1")
    return out.select("dispatch_id", (F.col("o.event") == "receipt").alias("submitted"), F.col("o.done").alias("written"), F.when(F.col("o.event") == "failure", F.col("o.error")).alias("error"))
