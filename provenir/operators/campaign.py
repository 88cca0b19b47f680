"""Verification campaigns: pending runs, latest observations, lane comparison, waivers, statistics, gates, sign-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAIVABLE = ("diverged", "regression", "failure_mismatch")
#: Outcomes that need neither a waiver nor a look.
AGREE = ("identical", "equivalent", "not_applicable", "consistent_failure", "recovered")


def pending(corpus: DataFrame, lanes: DataFrame, observed: DataFrame, at_most: int | None = None) -> DataFrame:
    """(path, lane) not yet observed: the corpus by the lanes, less what was seen. The lanes are gathered into one row, which
    goes beside each of the corpus. at_most: a batch of so many, the first by path and lane order."""
    names = lanes.agg(F.array_sort(F.collect_list(F.struct("lane_order", "lane"))).alias("lanes"))
    wanted = corpus.select("path").crossJoin(F.broadcast(names)).select("path", F.explode("lanes").alias("l")).select("path", "l.lane", "l.lane_order")
    left = wanted.join(observed.select("path", "lane"), ["path", "lane"], "left_anti")
    return (left if at_most is None else left.orderBy("path", "lane_order").limit(at_most)).select("path", "lane")


def header_problems(written: DataFrame, wanted: DataFrame) -> DataFrame:
    """(field, problem) where a journal's header (one row, field by field) is not that of the campaign that resumes it: both
    are (field, value); a journal may be resumed only if there is none."""
    both = written.select("field", F.col("value").alias("a")).join(wanted.select("field", F.col("value").alias("b")), "field", "full_outer")
    problem = F.when(F.col("b").isNull(), "unknown").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "differs")
    return both.select("field", problem.alias("problem")).where("problem is not null")


def latest(journal: DataFrame) -> DataFrame:
    """The last observation (greatest line) of each document and lane."""
    rest = [c for c in journal.columns if c not in ("path", "lane")]
    return journal.groupBy("path", "lane").agg(F.max_by(F.struct(*rest), "line").alias("o")).select("path", "lane", "o.*")


def compare_lanes(corpus: DataFrame, observations: DataFrame, baseline: str, candidates: list[str], accepted: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(path, lane, outcome, ratio) of each document and candidate lane against the baseline.

    observations: path, lane, status, reason, artifact_hash, wall_time_seconds. accepted: (path, lane) whose difference a
    policy accepts. records: record_id of those in the ledger; two sealed observations (record_id) of which one names no
    record are an error. The rules are tried in order, and every document has an outcome in every lane."""
    if records is not None:
        observations = observations.join(records.select("record_id").distinct().withColumn("recorded", F.lit(True)), "record_id", "left")
    else:
        observations = observations.withColumn("recorded", F.lit(True))
    base = observations.where(F.col("lane") == baseline).select("path", *[F.col(c).alias(f"b_{c}") for c in ("status", "reason", "artifact_hash", "wall_time_seconds", "recorded")])
    wanted = corpus.select("path", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("lane"))
    joined = wanted.join(observations.select("path", "lane", "status", "reason", "artifact_hash", "wall_time_seconds", "recorded"), ["path", "lane"], "left").join(base, "path", "left")
    if accepted is not None:
        joined = joined.join(accepted.select("path", "lane").distinct().withColumn("accepted", F.lit(True)), ["path", "lane"], "left")
    else:
        joined = joined.withColumn("accepted", F.lit(False))
    b, c = F.col("b_status"), F.col("status")
    either = lambda x: (b == x) | (c == x)
    outcome = (
        F.when(b.isNull() | c.isNull(), "incomplete").when(either("error") | either("containment_error"), "error")
        .when((b == "not_applicable") & (c == "not_applicable"), "not_applicable").when(either("not_applicable"), "failure_mismatch")
        .when((b == "sealed") & (c == "sealed"), F.when(F.col("recorded").isNull() | F.col("b_recorded").isNull(), "error").when(F.col("artifact_hash") == F.col("b_artifact_hash"), "identical").when(F.col("accepted"), "equivalent").otherwise("diverged"))
        .when(b == "sealed", "regression").when(c == "sealed", "recovered")
        .when(F.col("reason").eqNullSafe(F.col("b_reason")), "consistent_failure").otherwise("failure_mismatch")
    )
    ratio = F.when(F.col("b_wall_time_seconds") > 0, F.col("wall_time_seconds") / F.col("b_wall_time_seconds"))
    return joined.select("path", "lane", outcome.alias("outcome"), F.when(outcome.isin("identical", "equivalent"), ratio).alias("ratio"))


def slowdowns(compared: DataFrame) -> DataFrame:
    """(lane, n, median_slowdown) over documents with identical or equivalent output and both times."""
    return compared.where("ratio is not null").groupBy("lane").agg(F.count("*").alias("n"), F.round(F.median("ratio"), 6).alias("median_slowdown"))


def apply_waivers(compared: DataFrame, waivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that no waiver covers, waivers that match nothing). Only three outcomes can be waived, and only with a reason."""
    keys = ["path", "lane", "outcome"]
    valid = waivers.where(F.col("outcome").isin(*WAIVABLE) & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    found = compared.where(~F.col("outcome").isin(*AGREE))
    return found.join(valid.select(*keys), keys, "left_anti"), waivers.join(compared.select(*keys), keys, "left_anti")


def lane_statuses(observations: DataFrame) -> DataFrame:
    return observations.groupBy("lane", "status").agg(F.count("*").alias("n"))


def failure_reasons(observations: DataFrame) -> DataFrame:
    return observations.where("status = 'failed'").groupBy("lane", F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def lane_stats(observations: DataFrame, value: str = "wall_time_seconds") -> DataFrame:
    """(lane, n, p50, p95, max): nearest-rank percentiles, nulls left out, six decimals."""
    rank = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by {value})"), 6)
    return observations.groupBy("lane").agg(F.count(value).alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.round(F.max(value), 6).alias("max"))


def double_claims(observations: DataFrame) -> DataFrame:
    """Observations of a record that an earlier document or lane has claimed: order (doc_id, lane_order), the first keeps it."""
    first = Window.partitionBy("record_id").orderBy("doc_id", "lane_order")
    return observations.where("record_id is not null").withColumn("n", F.row_number().over(first)).where("n > 1").select("record_id", "path", "lane")


def gates(corpus: DataFrame, lanes: list[str], baseline: str, observations: DataFrame, compared: DataFrame, unwaived: DataFrame, unused: DataFrame, max_failure_rate: float, max_slowdown: float, drift: DataFrame | None = None, integrity: DataFrame | None = None, ledger: list[DataFrame] | None = None) -> DataFrame:
    """(gate, passed, value): corpus unchanged, coverage, baseline output, errors, records and ledger verified, agreement,
    waivers, failure rate, slowdown.

    drift: differences of the corpus from its manifest. integrity: problems of sealed records. ledger: problems of the chain
    and of its reconciliation with the tables. What was not looked at does not pass, and has no value. Each number is one aggregate over a whole table; the few rows of numbers are put side by side by one more."""
    wanted = corpus.select("path", F.explode(F.array(*[F.lit(x) for x in lanes])).alias("lane")).join(observations.select("path", "lane").withColumn("seen", F.lit(1)), ["path", "lane"], "left")
    status = F.col("status")
    base = observations.where(F.col("lane") == baseline).agg(F.count_if(status == "sealed").alias("sealed"), F.count_if(status == "failed").alias("failed"), F.count_if(status != "not_applicable").alias("applicable"))
    numbers = [
        corpus.agg(F.count("*").alias("documents")), wanted.agg(F.count_if(F.col("seen").isNull()).alias("missing")), base,
        observations.agg(F.count_if(status.isin("error", "containment_error")).alias("errors")), slowdowns(compared).agg(F.count_if(F.col("median_slowdown") > max_slowdown).alias("slow")),
        unwaived.agg(F.count("*").alias("unwaived")), unused.agg(F.count("*").alias("unused")),
    ]
    found = {"changed": [drift], "unsound": [integrity], "unreconciled": ledger or [None]}
    for name, parts in found.items():
        numbers += [df.agg(F.count("*").alias(f"{name}_{i}")) for i, df in enumerate(parts) if df is not None]
    names = [c for df in numbers for c in df.columns]
    total = {name: sum((F.col(f"{name}_{i}") for i in range(1, len(parts))), F.col(f"{name}_0")) if None not in parts else F.lit(None).cast("long") for name, parts in found.items()}
    clean = lambda name: F.coalesce(total[name] == 0, F.lit(False))
    long = None
    for df in numbers:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in df.columns])).alias("x")).select("x.*")
        long = rows if long is None else long.unionByName(rows)
    one = long.agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in names])
    rate = F.when(F.col("applicable") > 0, F.col("failed") / F.col("applicable")).otherwise(0.0)
    row = lambda name, passed, value: F.struct(F.lit(name).alias("gate"), passed.alias("passed"), value.cast("double").alias("value"))
    rows = F.array(
        row("corpus_unchanged", clean("changed"), total["changed"]), row("records_verified", clean("unsound"), total["unsound"]), row("ledger_verified", clean("unreconciled"), total["unreconciled"]),
        row("coverage", (F.col("missing") == 0) & (F.col("documents") > 0), F.col("missing")), row("baseline_produced_output", F.col("sealed") > 0, F.col("sealed")),
        row("no_errors", F.col("errors") == 0, F.col("errors")), row("candidates_agree", F.col("unwaived") == 0, F.col("unwaived")), row("waivers_used", F.col("unused") == 0, F.col("unused")),
        row("baseline_failure_rate", rate <= max_failure_rate, rate), row("slowdown", F.col("slow") == 0, F.col("slow")),
    )
    return one.select(F.explode(rows).alias("g")).select("g.*")


def stale_signoffs(signoffs: DataFrame, records: DataFrame) -> DataFrame:
    """(signoff_id, record_id, problem): signed records that are gone, no longer sealed, or have other contents."""
    now = records.select("record_id", "state", F.col("artifact_hash").alias("hash"))
    joined = signoffs.join(now, "record_id", "left")
    problem = F.when(F.col("state").isNull(), "gone").when(F.col("state") != "sealed", F.concat(F.lit("is "), F.col("state"))).when(F.col("hash") != F.col("artifact_hash"), "other contents")
    return joined.select("signoff_id", "record_id", problem.alias("problem")).where("problem is not null")


def lost_heads(heads: DataFrame, chain: DataFrame) -> DataFrame:
    """(signoff_id, problem) of sign-offs (signoff_id, head_seq, head_hash) whose report was made on a head that the chain
    (seq, hash) does not hold any more."""
    joined = heads.join(chain.select(F.col("seq").alias("head_seq"), "hash"), "head_seq", "left")
    problem = F.when(F.col("head_seq") == 0, None).when(F.col("hash").isNull(), "head missing").when(F.col("hash") != F.col("head_hash"), "head differs")
    return joined.select("signoff_id", problem.alias("problem")).where("problem is not null")


def observe(runs: DataFrame) -> DataFrame:
    """runs (applicable, host_error, refusal, failure) with status: how one document and lane went."""
    status: Column = F.when(~F.col("applicable"), "not_applicable").when(F.col("host_error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("refusal").isNotNull(), "containment_error").otherwise("sealed")
    return runs.withColumn("status", status)


#: Parts of a report; a parse takes these and no others.
REPORT = ("schema", "schema_version", "corpus", "documents", "parser", "lanes", "ledger_head", "waivers", "gates", "passed", "statuses", "outcomes", "generated_at")


def report(gate_rows: DataFrame, statuses: DataFrame, outcomes: DataFrame, **about: object) -> str:
    """A campaign's report as canonical JSON: what it is about (corpus digest, number of documents, parser, lanes, ledger
    head, waivers, generated_at; null if not given), its gates and counts, a few rows each, and whether all gates passed."""
    import json

    unknown = about.keys() - set(REPORT)
    if unknown:
        raise ValueError(f"no parts of a report: {sorted(unknown)}")
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    counted = outcomes.groupBy("lane", "outcome").agg(F.count("*").alias("n"))
    gates_ = rows(gate_rows, "gate")
    body = {**dict.fromkeys(REPORT), **about, "schema": "report", "schema_version": 1, "gates": gates_, "passed": all(g["passed"] for g in gates_), "statuses": rows(statuses, "lane", "status"), "outcomes": rows(counted, "lane", "outcome")}
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_report(text: str) -> dict:
    """A report's parts; ValueError unless the text is the canonical form of exactly these, of this version, and passed says
    what its gates say."""
    import json

    body = json.loads(text)
    if not isinstance(body, dict) or set(body) != set(REPORT):
        raise ValueError("parts missing or unknown")
    if (body["schema"], body["schema_version"]) != ("report", 1):
        raise ValueError("another schema or version")
    if body["passed"] != all(g["passed"] for g in body["gates"]):
        raise ValueError("passed is not what the gates say")
    if json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) != text:
        raise ValueError("not in canonical form")
    return body


def failed_gates(text: str) -> list[str]:
    return [g["gate"] for g in parse_report(text)["gates"] if not g["passed"]]


def rebuild_problems(old: str, new: str, ignore: tuple[str, ...] = ("generated_at", "ledger_head")) -> list[str]:
    """The parts in which a report differs from its rebuild, but for those that may."""
    import json

    a, b = json.loads(old), json.loads(new)
    return sorted(k for k in (a.keys() | b.keys()) - set(ignore) if a.get(k) != b.get(k))
