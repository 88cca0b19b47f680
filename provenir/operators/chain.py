"""Hash-chained event logs: generation, parallel verification, anchors, reconciliation with tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.canon import GENESIS, event_hash, quote_json
from provenir.session import stored

_EVENT = ("kind", "subject", "body", "at")


def build_chain(events: DataFrame, chain: str = "chain", first: int = 0, prev: str = GENESIS) -> DataFrame:
    """(chain, seq, kind, subject, body, at, prev_hash, hash) for events (chain, ord, kind, subject, body, at), each chain
    from number first + 1 on after the hash prev.

    Each hash needs the one before it, so one chain is hashed by one task, and chains run in parallel. Rows arrive in order,
    by Arrow batches, and only the last hash is carried on: the work is linear, and no chain is held in memory."""
    text = lambda c: F.coalesce(quote_json(F.col(c)), F.lit("null"))
    head = F.concat(F.lit('{"at":'), text("at"), F.lit(',"body":'), text("body"), F.lit(',"kind":'), text("kind"), F.lit(',"prev":"'))
    rest = F.concat(F.lit(',"subject":'), text("subject"), F.lit("}"))
    ordered = events.select(chain, "ord", *_EVENT).repartition(chain).sortWithinPartitions(chain, "ord", *_EVENT)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, last = object(), first, prev
        for batch in batches:
            made: tuple[list, list, list] = ([], [], [])
            for key, before, after in zip(*(batch.column(i).to_pylist() for i in (0, 5, 6))):
                if key != own:
                    own, seq, last = key, first, prev
                seq += 1
                digest = hashlib.sha256(f'{before}{last}","seq":{seq}{after}'.encode()).hexdigest()
                for out, value in zip(made, (seq, last, digest)):
                    out.append(value)
                last = digest
            numbers, befores, digests = pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())
            yield pa.record_batch([batch.column(0), numbers, *(batch.column(i) for i in range(1, 5)), befores, digests], names=[chain, "seq", *_EVENT, "prev_hash", "hash"])

    kind = events.schema[chain].dataType.simpleString()
    schema = f"`{chain}` {kind}, seq long, kind string, subject string, body string, `at` string, prev_hash string, hash string"
    return ordered.select(chain, *_EVENT, head.alias("before"), rest.alias("after")).mapInArrow(link, schema)


def verify_chain(chain: DataFrame, key: str = "chain") -> DataFrame:
    """(key, seq, problem, rank): gap, broken link, altered row, in this order within a row.

    Every row states the hash before it, so neighbours are compared by an equi-join on seq - 1, which deals a long chain
    out to many tasks; only where a number is missing is the row before looked for otherwise, by a window over the
    rows that border on gaps. The rows are hashed once, and what is compared is stored."""
    own = stored(chain.select(key, "seq", "prev_hash", "hash", event_hash(F.col("seq"), F.col("kind"), F.col("subject"), F.col("body"), F.col("at"), F.col("prev_hash")).alias("made")))
    before = own.select(key, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("last"))
    joined = own.join(before, [key, "seq"], "left")
    joined = joined.withColumn("last", F.when((F.col("seq") == 1) & F.col("last").isNull(), F.lit(GENESIS)).otherwise(F.col("last")))
    after = own.join(own.select(key, (F.col("seq") - 1).alias("seq")).withColumn("next", F.lit(True)), [key, "seq"], "left").where("next is null").select(key, "seq", "hash", F.lit(True).alias("ends"))
    starts = joined.where("last is null").select(key, "seq", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("ends"))
    edge = after.unionByName(starts)
    back = Window.partitionBy(key).orderBy("seq", "ends").rowsBetween(Window.unboundedPreceding, -1)
    found = edge.withColumn("previous", F.last(F.when(F.col("ends"), F.col("hash")), ignorenulls=True).over(back)).where("not ends").select(key, "seq", F.coalesce("previous", F.lit(GENESIS)).alias("previous"))
    gaps = joined.where("last is null").join(found, [key, "seq"]).select(key, "seq", F.lit("gap").alias("problem"), F.lit(1).alias("rank"), "previous")
    linked = joined.join(gaps.select(key, "seq", "previous"), [key, "seq"], "left").withColumn("last", F.coalesce("last", "previous"))
    broken = linked.where("prev_hash <> last").select(key, "seq", F.lit("broken").alias("problem"), F.lit(2).alias("rank"))
    altered = own.where("made <> hash").select(key, "seq", F.lit("altered").alias("problem"), F.lit(3).alias("rank"))
    return gaps.drop("previous").unionByName(broken).unionByName(altered)


def heads(chain: DataFrame, key: str = "chain") -> DataFrame:
    """(key, length, head): the last number, not the number of rows, and its hash."""
    return chain.groupBy(key).agg(F.max("seq").alias("length"), F.max_by("hash", "seq").alias("head"))


def check_anchor(chain: DataFrame, anchors: DataFrame, key: str = "chain") -> DataFrame:
    """(key, verdict) for anchors (key, anchor_seq, anchor_hash): ok, truncated, differs, or gap if that number is missing."""
    joined = anchors.join(chain, key, "left").groupBy(key, "anchor_seq", "anchor_hash").agg(F.max("seq").alias("last"), F.max(F.when(F.col("seq") == F.col("anchor_seq"), F.col("hash"))).alias("at"))
    verdict = F.when(F.coalesce(F.col("last"), F.lit(0)) < F.col("anchor_seq"), "truncated").when(F.col("at").isNull(), "gap").when(F.col("at") != F.col("anchor_hash"), "differs").otherwise("ok")
    return joined.select(key, verdict.alias("verdict"))


def tail(chain: DataFrame, after: int) -> DataFrame:
    return chain.where(F.col("seq") > after)


def reconcile(expected: DataFrame, actual: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, problem) between a table as the chain has it and as it is: only in one, or fields that differ."""
    mine = expected.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("e"))
    real = actual.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    both = mine.join(real, key, "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())
    problems = F.when(F.col("a").isNull(), F.array(F.lit("only in chain"))).when(F.col("e").isNull(), F.array(F.lit("only in ledger"))).otherwise(differing)
    return both.select(key, F.explode(problems).alias("problem"))


def reconcile_lists(expected: DataFrame, actual: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """(key) whose ordered lists of rows differ."""
    listed = lambda df, to: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(to))
    both = listed(expected, "e").join(listed(actual, "a"), key, "full_outer")
    return both.where(~F.col("e").eqNullSafe(F.col("a"))).select(key)
