"""References held against evidence: what resolves, and why what does not; the references of a record; record checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions import refs
from provenir.functions.canon import PREFIX


def resolve(given: DataFrame, sources: DataFrame, snapshots: DataFrame, records: DataFrame, bundles: DataFrame, chain: DataFrame, chain_ok: bool, allow_invalidated: bool = False, prefix: str = PREFIX) -> DataFrame:
    """given (ref) with problem, null where it resolves.

    sources: source_id. snapshots: kind, digest, ok (content verifies). records: record_id, state, artifact_hash,
    observation_digest. bundles: record_id, ok. chain: seq, hash; an event resolves only in a chain that is whole.
    Observations resolve in any state; records only sealed (or invalidated, where allowed)."""
    parsed = given.withColumn("p", refs.parse_ref(F.col("ref"), prefix)).select("ref", "p.type", "p.id", "p.digest")
    a = sources.select(F.col("source_id").alias("digest")).distinct().withColumns({"type": F.lit("source"), "source": F.lit(True)})
    b = snapshots.groupBy(F.col("kind").alias("id"), "digest").agg(F.bool_and("ok").alias("snapshot")).withColumn("type", F.lit("snapshot"))
    c = records.join(bundles.select("record_id", F.col("ok").alias("whole")), "record_id", "left").select(F.col("record_id").alias("id"), "state", "artifact_hash", "observation_digest", "whole")
    d = chain.select(F.col("seq").cast("string").alias("id"), F.col("hash").alias("event")).withColumn("type", F.lit("event"))
    joined = parsed.join(a, ["type", "digest"], "left").join(b, ["type", "id", "digest"], "left").join(c, "id", "left").join(d, ["type", "id"], "left")
    states = ["sealed", *["invalidated"] * allow_invalidated]
    record = F.when(F.col("state").isNull(), "no record").when(~F.col("state").isin(*states), F.concat(F.lit("record is "), F.col("state"))).when(F.col("artifact_hash") != F.col("digest"), "other output").when(~F.coalesce("whole", F.lit(False)), "output does not verify")
    problem = (
        F.when(F.col("type").isNull(), "not a reference").when(F.col("type") == "source", F.when(F.col("source").isNull(), "no source"))
        .when(F.col("type") == "snapshot", F.when(F.col("snapshot").isNull(), "no snapshot").when(~F.col("snapshot"), "snapshot does not verify")).when(F.col("type").isin("record", "anchor"), record)
        .when(F.col("type") == "observation", F.when(F.col("state").isNull(), "no record").when(~F.col("observation_digest").eqNullSafe(F.col("digest")), "other observation"))
        .when(F.col("type") == "event", F.when(~F.lit(chain_ok), "chain does not verify").when(F.col("event").isNull(), "no event").when(F.col("event") != F.col("digest"), "other event"))
    )
    return joined.select("ref", problem.alias("problem"))


def of_record(records: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, ref): the references of records (record_id, artifact_hash, source_kind, source_hash, created_at) and of
    their events (subject, seq, hash)."""
    observed = refs.observation_digest(F.col("record_id"), F.lit(None).cast("string"), F.col("source_kind"), F.col("source_hash"), F.col("created_at"))
    made = F.array(refs.record_ref(F.col("record_id"), F.col("artifact_hash")), refs.observation_ref(F.col("record_id"), observed), refs.snapshot_ref(F.col("source_kind"), F.col("source_hash")))
    own = records.select("record_id", F.explode(made).alias("ref"))
    logged = events.select(F.col("subject").alias("record_id"), refs.event_ref(F.col("seq"), F.col("hash")).alias("ref")).join(records.select("record_id"), "record_id", "left_semi")
    return own.unionByName(logged).where("ref is not null")


def record_problems(observations: DataFrame, records: DataFrame, corpus: DataFrame, validations: DataFrame, backends: dict[str, str], parser: tuple[str, str]) -> DataFrame:
    """(path, lane, problem): every way in which a sealed observation and the record it names disagree.

    observations: path, lane, doc_id, lane_order, record_id, run_id, artifact_hash. records: record_id, run_id, state,
    artifact_hash, parser_name, parser_version, backend, source_hash. corpus: path, sha256. validations: record_id, status."""
    real = records.select("record_id", *[F.col(c).alias(f"r_{c}") for c in ("run_id", "state", "artifact_hash", "parser_name", "parser_version", "backend", "source_hash")])
    lanes = F.create_map(*[F.lit(x) for pair in backends.items() for x in pair]) if backends else F.create_map().cast("map<string,string>")
    order = Window.partitionBy("record_id").orderBy("doc_id", "lane_order")
    joined = observations.withColumn("nth", F.row_number().over(order)).join(real, "record_id", "left").join(corpus.select("path", "sha256"), "path", "left").join(validations.select("record_id", F.col("status").alias("valid")), "record_id", "left")
    name, version = parser
    checks = {
        "not sealed": F.col("r_state") != "sealed", "another run": ~(F.col("r_run_id").eqNullSafe(F.col("run_id")) & F.col("r_artifact_hash").eqNullSafe(F.col("artifact_hash"))),
        "another parser": ~(F.col("r_parser_name").eqNullSafe(F.lit(name)) & F.col("r_parser_version").eqNullSafe(F.lit(version))), "another backend": ~F.col("r_backend").eqNullSafe(F.try_element_at(lanes, F.col("lane"))),
        "claimed twice": F.col("nth") > 1, "another input": ~F.col("r_source_hash").eqNullSafe(F.col("sha256")), "does not verify": ~F.coalesce(F.col("valid").isin("ok", "archived"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return joined.select("path", "lane", F.explode(F.when(F.col("r_state").isNull(), F.array(F.lit("not in the ledger"))).otherwise(found)).alias("problem"))
