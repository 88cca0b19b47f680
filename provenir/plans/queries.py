"""A query for each operator over the given tables, and DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import canon, refs
from provenir.operators import campaign, chain, commits, compare, conversations, delivery, failures, ledger, manifests, markdown, resolution
from provenir.plans.views import view, with_views
from provenir.session import ship, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LANES, BASE = ["base", "cand_a", "cand_b"], "base"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Content addressing.


@query("select doc_id, sha256(text) as digest, octet_length(encode(text))::bigint as size from documents")
def doc_digest(spark, d):
    return read(spark, d, "documents").select("doc_id", canon.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("""select lang, count(*) as files, sha256(string_agg('doc/' || lpad(doc_id::varchar, 8, '0') || chr(0) || sha256(text) || chr(0), '' order by doc_id)) as digest
from documents group by lang""")
def tree_digest_by_lang(spark, d):
    entries = read(spark, d, "documents").select("lang", F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), canon.sha256(F.col("text")).alias("digest"))
    return manifests.tree_digest(entries, "lang")


@query("""select record_id, count(*) as files, sha256(string_agg(path || chr(0) || digest || chr(0), '' order by path)) as digest from v_manifest group by record_id""")
def bundle_tree_digest(spark, d):
    return manifests.tree_digest(view(spark, d, "v_manifest"), "record_id")


@query("select record_id, path, digest from v_manifest")
def tree_encode_decode(spark, d):
    trees = view(spark, d, "v_manifest").groupBy("record_id").agg(manifests.tree_text(F.col("path"), F.col("digest")).alias("tree"))
    return manifests.decode_tree(trees, "tree", "record_id")


@query("select sha256(text) as digest, max(octet_length(encode(text)))::bigint as size, count(*) as copies from documents group by 1")
def blob_dedup(spark, d):
    files = read(spark, d, "documents").select(canon.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return manifests.distinct_blobs(files)


@query("""select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change
from v_corpus a full join v_present b on a.path = b.path where a.digest is distinct from b.digest""")
def corpus_drift(spark, d):
    return manifests.corpus_drift(view(spark, d, "v_corpus"), view(spark, d, "v_present"))


@query("select path, digest, n_chars::bigint as n_chars from v_corpus")
def corpus_manifest(spark, d):
    return view(spark, d, "v_corpus").select("path", "digest", F.col("n_chars").cast("long").alias("n_chars"))


@query("""select coalesce(a.record_id, b.record_id) as record_id, coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change
from v_manifest a full join v_disk b on a.record_id = b.record_id and a.path = b.path where a.digest is distinct from b.digest""")
def manifest_diff(spark, d):
    return manifests.manifest_diff(view(spark, d, "v_manifest"), view(spark, d, "v_disk"), "record_id")


@query("""with s as (select digest, bool_and(sha256(content) = digest) as ok from v_blobs group by digest)
select record_id, count(*) as files, count(*) filter (ok is null) as missing, count(*) filter (not ok) as bad,
  count(*) filter (ok is null) = 0 and count(*) filter (not ok) = 0 as ok from v_manifest left join s using (digest) group by record_id""")
def bundle_verify(spark, d):
    return manifests.bundle_verify(view(spark, d, "v_manifest"), view(spark, d, "v_blobs"))


@query("""with s as (select digest, bool_and(sha256(content) = digest) as ok from v_blobs group by digest), b as (select record_id, count(*) filter (ok is null) as missing, count(*) filter (not ok) as bad from v_manifest left join s using (digest) group by record_id)
select record_id, unnest(list_filter([case when doc_id % 9 = 0 then 'another tree' end, case when missing > 0 then 'blobs missing' end, case when bad > 0 then 'blobs altered' end], lambda x: x is not null)) as problem from v_records join b using (record_id)
union all select 'none-' || doc_id, 'no tree' from v_records""")
def bundle_problems(spark, d):
    """Records that seal their tree's digest, but for some, and records without a bundle."""
    manifest, given = view(spark, d, "v_manifest"), view(spark, d, "v_records").select("doc_id", "record_id")
    sealed = given.join(manifests.tree_digest(manifest, "record_id"), "record_id").select("record_id", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("digest")).alias("artifact_hash"))
    none = given.select(F.concat(F.lit("none-"), F.col("doc_id").cast("string")).alias("record_id"), F.lit("x").alias("artifact_hash"))
    return manifests.bundle_problems(manifest, view(spark, d, "v_blobs"), sealed.unionByName(none))


@query("""with f as (select doc_id, source, sha256(text) as digest, octet_length(encode(text))::bigint as size from documents)
select 'file-' || doc_id as input_id, 'file' as kind, digest, size, 1::bigint as file_count from f
union all select 'dir-' || source, 'tree', sha256(string_agg('doc/' || lpad(doc_id::varchar, 8, '0') || chr(0) || digest || chr(0), '' order by doc_id)), sum(size)::bigint, count(*) from f where source is not null group by source
union all select 'dir-empty', 'tree', sha256(''), 0, 0""")
def staged_snapshots(spark, d):
    files = read(spark, d, "documents").select("doc_id", "source", canon.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    path = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path")
    single, folder = F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("input_id"), F.concat(F.lit("dir-"), "source").alias("input_id")
    listed = files.select(single, path, "digest", "size").unionByName(files.where("source is not null").select(folder, path, "digest", "size"))
    inputs = listed.select("input_id").distinct().withColumn("is_dir", F.startswith("input_id", F.lit("dir-"))).unionByName(spark.createDataFrame([("dir-empty", True)], "input_id string, is_dir boolean"))
    return manifests.staged_snapshots(listed, inputs)


@query("select record_id, path, digest from v_manifest where digest not in (select digest from v_blobs)")
def missing_blobs(spark, d):
    return manifests.missing_blobs(view(spark, d, "v_manifest"), view(spark, d, "v_blobs")).select("record_id", "path", "digest")


@query("""select record_id, sum(size)::bigint as size, count(*) as file_count from v_manifest join (select digest, max(size) as size from v_blobs group by digest) using (digest) group by record_id""")
def snapshot_totals(spark, d):
    return manifests.snapshot_totals(view(spark, d, "v_manifest"), view(spark, d, "v_blobs"), "record_id")


@query("select page_id, sha256('{\"locator\":' || to_json(url) || ',\"schema\":\"provenir.source\",\"schema_version\":1}') as source_id from pages where url <> ''")
def source_identity(spark, d):
    return read(spark, d, "pages").where("url <> ''").select("page_id", canon.source_id(F.col("url")).alias("source_id"))


@query("""select doc_id, '{"digest":"' || sha256(text) || '","file_count":1,"kind":"file","schema":"provenir.snapshot","schema_version":1,"size":' || octet_length(encode(text)) || '}' as record from documents""")
def snapshot_record(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", canon.snapshot_record(F.lit("file"), canon.sha256(F.col("text")), F.octet_length("text"), F.lit(1)).alias("record"))


@query()
def canonical_props(spark, d):
    """Arbitrary JSON in canonical form, and its digest."""
    text = canon.canonical_json(F.col("props"))
    return read(spark, d, "events").select("event_id", text.alias("canonical")).withColumn("digest", canon.sha256(F.col("canonical")))


@query("""select case when doc_id % 3 = 0 then upper(sha256(text)) when doc_id % 7 = 0 then sha256(text) || chr(10) else sha256(text) end as value,
  regexp_full_match(case when doc_id % 3 = 0 then upper(sha256(text)) when doc_id % 7 = 0 then sha256(text) || chr(10) else sha256(text) end, '[0-9a-f]{64}') as ok from documents""")
def digest_predicate(spark, d):
    digest = canon.sha256(F.col("text"))
    value = F.when(F.col("doc_id") % 3 == 0, F.upper(digest)).when(F.col("doc_id") % 7 == 0, F.concat(digest, F.lit("\n"))).otherwise(digest)
    return read(spark, d, "documents").select(value.alias("value")).select("value", canon.is_digest(F.col("value")).alias("ok"))


@query("""with r as (select record_id, path, octet_length(encode(path))::bigint as size from v_manifest),
n as (select *, row_number() over w as n, sum(size) over (partition by record_id order by path rows unbounded preceding) as total from r window w as (partition by record_id order by path))
select record_id, count(*) filter (n <= 2 and total <= 15) as kept, max(case when not (n <= 2 and total <= 15) then 'output_limit' end) as over from n group by record_id""")
def output_limits(spark, d):
    return manifests.output_limits(view(spark, d, "v_manifest").withColumn("size", F.octet_length("path").cast("long")), 15, 2)


@query("""with m as (select record_id, path from v_manifest), o as (select record_id, case when doc_id % 4 = 0 then '{"outputs":{"markdown":"other.md"}}' when doc_id % 4 = 1 then '{"outputs":{"markdown":"parser.json"}}' else '{}' end as body from v_records),
w as (select record_id, coalesce(body ->> '$.outputs.markdown', 'document.md') as wanted from o)
select w.record_id, m.path from w left join m on w.record_id = m.record_id and w.wanted = m.path""")
def markdown_choice(spark, d):
    body = F.when(F.col("doc_id") % 4 == 0, '{"outputs":{"markdown":"other.md"}}').when(F.col("doc_id") % 4 == 1, '{"outputs":{"markdown":"parser.json"}}').otherwise("{}")
    return manifests.markdown_path(view(spark, d, "v_manifest"), view(spark, d, "v_records").select("record_id", body.alias("body")))


# The ledger.


@query("""select record_id, run_id, created_at from v_records where parser_name = 'marker' and parser_version = '1.0' and run_conditions ->> '$.device' = 'gpu'""")
def records_by_parser(spark, d):
    return ledger.by_parser(view(spark, d, "v_records"), "marker", "1.0", device="gpu").select("record_id", "run_id", "created_at").orderBy(*ledger.LISTING)


@query("select record_id, state, created_at from v_records where state in ('failed', 'invalidated')")
def records_by_state(spark, d):
    return view(spark, d, "v_records").where(F.col("state").isin("failed", "invalidated")).select("record_id", "state", "created_at")


@query("select record_id, run_id from v_records where source_hash in (select digest from v_snapshots)")
def records_by_source_hash(spark, d):
    """Records of any source that was archived."""
    looked_up = view(spark, d, "v_snapshots").select(F.col("digest").alias("source_hash")).distinct()
    return view(spark, d, "v_records").join(looked_up, "source_hash", "left_semi").select("record_id", "run_id")


@query("""select 'all' as view, count(*) as n from v_records union all select 'pending', count(*) from v_records where state = 'pending'
union all select 'sealed', count(*) from v_records where state = 'sealed' union all select 'invalidated_or_failed', count(*) from v_records where state in ('invalidated', 'failed')""")
def views_partition(spark, d):
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "n") for k, df in ledger.views(view(spark, d, "v_records")).items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("select source_hash as run_id, count(*) as n from v_records group by 1 having count(*) > 1")
def duplicate_runs(spark, d):
    return ledger.duplicate_runs(view(spark, d, "v_records").select(F.col("source_hash").alias("run_id")))


@query("""with b as (select subject, min(seq) as begun from v_record_events where kind = 'record.created' group by 1)
select e.subject as record_id, case arg_max(kind, seq) when 'record.created' then 'pending' when 'record.sealed' then 'sealed' when 'record.failed' then 'failed' else 'invalidated' end as state
from v_record_events e join b on e.subject = b.subject and seq >= begun group by 1""")
def state_fold(spark, d):
    return ledger.fold_states(view(spark, d, "v_record_events"))


@query("""with recursive o as (select *, row_number() over (partition by subject order by seq) as n from v_record_events),
f as (select subject, n, seq, kind, null::varchar as was, case when kind = 'record.created' then 'pending' end as state from o where n = 1
  union all
  select o.subject, o.n, o.seq, o.kind, f.state, case when o.kind = 'record.sealed' and f.state = 'pending' then 'sealed' when o.kind = 'record.failed' and f.state in ('pending', 'failed') then 'failed'
    when o.kind = 'record.invalidated' and f.state in ('pending', 'sealed') then 'invalidated' else f.state end from o join f on o.subject = f.subject and o.n = f.n + 1)
select subject as record_id, seq, kind, was as from_state from f where not coalesce(case kind when 'record.created' then was is null when 'record.sealed' then was = 'pending' when 'record.failed' then was in ('pending', 'failed') else was in ('pending', 'sealed') end, false)""")
def illegal_transitions(spark, d):
    return ledger.illegal_transitions(view(spark, d, "v_record_events"))


_VALIDATION = """v as (select record_id, path, case when safe is null then (case when ok then 'archived' else 'missing' end) when not safe or k.digest <> m.digest then 'drift' else 'ok' end as status
  from v_manifest m left join v_disk k using (record_id, path) left join (select distinct digest, true as ok from v_blobs where sha256(content) = digest) b on b.digest = m.digest)"""


@query(f"with {_VALIDATION} select record_id, path, status from v")
def validation_files(spark, d):
    return ledger.validate(view(spark, d, "v_manifest"), view(spark, d, "v_disk"), manifests.verified_blobs(view(spark, d, "v_blobs")))


@query(f"""with {_VALIDATION}, r as (select record_id, case max(case status when 'missing' then 3 when 'drift' then 2 when 'archived' then 1 else 0 end) when 3 then 'missing' when 2 then 'drift' when 1 then 'archived' else 'ok' end as status from v group by 1)
select status, count(*) as n from r group by 1""")
def validation_summary(spark, d):
    return ledger.validation_plan(validation_files(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("""with e as (select run_id, unnest(['cpus', 'memory', 'pids_limit', 'timeout_seconds', 'device']) as field, stated, applied from v_runs),
p as (select run_id, field, stated ->> ('$.' || field) as want, applied ->> ('$.' || field) as got from e)
select run_id, field, case when field = 'memory' and not (regexp_matches(want, '^(\\d+(\\.\\d+)?) ?[kKmMgGtTpP]?[iI]?[bB]?$') and regexp_extract(want, '^[0-9.]+')::double > 0) then 'malformed' when got is null then 'not reported' else 'differs' end as problem
from p where want is not null and (got is null or (field = 'memory' and regexp_extract(want, '^[0-9.]+')::double = 0) or not coalesce(try_cast(want as double) = try_cast(got as double), want = got))""")
def run_condition_problems(spark, d):
    return ledger.condition_problems(view(spark, d, "v_runs"))


@query("select run_id, memory_limit, coalesce(regexp_full_match(memory_limit, '(\\d+(\\.\\d+)?) ?[kKmMgGtTpP]?[iI]?[bB]?') and try_cast(regexp_extract(memory_limit, '^[0-9.]+') as double) > 0, false) as ok from v_runs")
def memory_limit_syntax(spark, d):
    return view(spark, d, "v_runs").select("run_id", "memory_limit", canon.memory_limit_ok(F.col("memory_limit")).alias("ok"))


@query("""with s as (select digest, max(kind) as kind from v_snapshots group by digest having count(distinct kind) = 1)
select run_id, case when old_state = 'committed' then (case when bundle_ok then 'sealed' else 'invalidated' end) else old_state end as state, s.digest as source_hash, s.kind as source_kind, case when s.digest is null then r.source_hash end as legacy_source_hash
from v_runs r left join s on r.source_hash = s.digest""")
def migration_states(spark, d):
    return ledger.migrate(view(spark, d, "v_runs").withColumn("state", F.col("old_state")), view(spark, d, "v_snapshots"))


@query("""select run_id, case when timed_out or exit_code <> 0 then 'run failed' when run_id % 5 = 0 then 'no artifacts' when run_id % 7 = 0 then 'input not archived' when run_id % 11 = 0 then 'input differs' when run_id % 13 = 0 then 'identity differs' end as refusal from v_runs""")
def run_refusals(spark, d):
    runs = view(spark, d, "v_runs").withColumns({
        "artifacts": F.when(F.col("run_id") % 5 == 0, 0).otherwise(1), "input_sha256": F.col("source_hash"),
        "snapshot_digest": F.when(F.col("run_id") % 7 == 0, None).when(F.col("run_id") % 11 == 0, F.lit("other")).otherwise(F.col("source_hash")),
        "claimed": F.when(F.col("run_id") % 13 == 0, "a"), "measured": F.lit("b"),
    })
    return ledger.run_refusals(runs).select("run_id", "refusal")


@query("select replay_id, null::varchar as policy, state as outcome from (select replay_id, state from v_replays)")
def replays_rebuilt(spark, d):
    """Replays copied into a table with a column more and without the old ones."""
    old = view(spark, d, "v_replays").select("replay_id", F.col("state").alias("outcome"), "differences")
    return ledger.rebuilt(old, {"replay_id": "string", "policy": "string", "outcome": "string"})


@query("""select section, id, key from (select 1 as section, record_id as id, created_at as key from v_records union all select 2, dispatch_id, created_at from v_deliveries
union all select 3, event_id::varchar, printf('%020d', event_id) from v_delivery_events union all select 4, replay_id, '2024' from v_replays)""")
def backfill_order(spark, d):
    return ledger.backfill_order(view(spark, d, "v_records"), view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events"), view(spark, d, "v_replays").withColumn("replayed_at", F.lit("2024")))


# Hash chains.

_CHAIN = """with recursive o as (select *, row_number() over (partition by chain order by ord) as seq from v_events_log),
c as (select chain, seq, kind, subject, body, "at", repeat('0', 64) as prev_hash, sha256('{"at":"' || "at" || '","body":' || to_json(body) || ',"kind":"' || kind || '","prev":"' || repeat('0', 64) || '","seq":1,"subject":"' || subject || '"}') as hash from o where seq = 1
  union all
  select o.chain, o.seq, o.kind, o.subject, o.body, o."at", c.hash, sha256('{"at":"' || o."at" || '","body":' || to_json(o.body) || ',"kind":"' || o.kind || '","prev":"' || c.hash || '","seq":' || o.seq || ',"subject":"' || o.subject || '"}') from o join c on o.chain = c.chain and o.seq = c.seq + 1)"""
_TAMPERED = _CHAIN + """, t as (select chain, seq, kind, subject, case when (seq + chain::bigint) % 97 = 0 then body || ' ' else body end as body, "at", prev_hash, hash from c where (seq + chain::bigint) % 89 <> 0)"""


def _chain(spark, d):
    """The chains, hashed once and stored: every reader below reads a log that is there."""
    return stored(chain.build_chain(view(spark, d, "v_events_log")))


def _tampered(spark, d):
    place = F.col("seq") + F.col("chain").cast("long")
    return _chain(spark, d).where(place % 89 != 0).withColumn("body", F.when(place % 97 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))


@query(_CHAIN + " select chain, max(seq) as length, arg_max(hash, seq) as head from c group by chain")
def chain_heads(spark, d):
    return chain.heads(_chain(spark, d))


@query(_TAMPERED + """, x as (select *, lag(seq) over w as s, lag(hash) over w as h from t window w as (partition by chain order by seq)),
p as (select chain, seq, 'gap' as problem, 1 as rank from x where seq <> coalesce(s, 0) + 1
  union all select chain, seq, 'broken', 2 from x where prev_hash <> coalesce(h, repeat('0', 64))
  union all select chain, seq, 'altered', 3 from x where (seq + chain::bigint) % 97 = 0)
select chain, seq, problem, rank from p""")
def chain_verify(spark, d):
    return chain.verify_chain(_tampered(spark, d))


@query(_TAMPERED + """, a as (select chain, max(seq) + (chain::bigint % 3 = 0)::int as s from t group by chain), b as (select a.chain, s, max(t.seq) as last, max(case when t.seq = a.s - 2 * (a.chain::bigint % 2) then hash end) as h from a join t using (chain) group by 1, 2)
select chain, case when last < s - 2 * (chain::bigint % 2) then 'truncated' when h is null then 'gap' when chain::bigint % 5 = 0 then 'differs' else 'ok' end as verdict from b""")
def chain_anchor(spark, d):
    rows = _tampered(spark, d)
    number = F.col("chain").cast("long")
    last = rows.groupBy("chain").agg(F.max("seq").alias("last"))
    wanted = last.select("chain", (F.col("last") + (number % 3 == 0).cast("int") - 2 * (number % 2)).alias("anchor_seq"))
    true = rows.select("chain", F.col("seq").alias("anchor_seq"), "hash")
    anchors = wanted.join(true, ["chain", "anchor_seq"], "left").select("chain", "anchor_seq", F.when(number % 5 == 0, F.lit("x")).otherwise(F.coalesce("hash", F.lit("x"))).alias("anchor_hash"))
    return chain.check_anchor(rows, anchors)


@query(_CHAIN + " select chain, seq, kind, hash from c where seq > 60")
def chain_tail(spark, d):
    return chain.tail(_chain(spark, d), 60).select("chain", "seq", "kind", "hash")


@query("""with b as (select subject, min(seq) as begun from v_record_events where kind = 'record.created' group by 1),
e as (select e.subject as record_id, case arg_max(kind, seq) when 'record.created' then 'pending' when 'record.sealed' then 'sealed' when 'record.failed' then 'failed' else 'invalidated' end as state
  from v_record_events e join b on e.subject = b.subject and seq >= begun group by 1)
select coalesce(e.record_id, s.record_id) as record_id, case when s.record_id is null then 'only in chain' when e.record_id is null then 'only in ledger' else 'state' end as problem
from e full join v_states s on e.record_id = s.record_id where e.state is distinct from s.state""")
def reconcile_records(spark, d):
    return chain.reconcile(ledger.fold_states(view(spark, d, "v_record_events")), view(spark, d, "v_states"), "record_id", ("state",))


#: The chain's records and, beside them, a ledger of which every key was altered somewhere.
_TOLD = """r as (select *, '{"model":"m' || doc_id % 3 || '"}' as config, '{"document.md":"' || source_hash || '"}' as manifest, sha256('document.md' || chr(0) || source_hash || chr(0)) as tree from v_records),
k as (select record_id, doc_id, doc_id % 37 = 8 as gone, doc_id % 41 = 9 as extra, doc_id % 23 = 5 as broken,
  list_filter([case when doc_id % 13 = 2 then 'artifact_hash' end, case when doc_id % 19 = 4 then 'parser' end, case when doc_id % 43 = 6 then 'parser_config' end, case when doc_id % 29 = 6 then 'run_conditions' end,
    case when doc_id % 11 = 1 then 'run_id' end, case when doc_id % 17 = 3 then 'source_hash' end, case when doc_id % 31 = 7 then 'state' end, case when doc_id % 13 = 2 or doc_id % 47 = 10 then 'manifest' end], lambda x: x is not null) as found from r)"""


@query(f"with {_TOLD} select record_id, unnest(case when gone and extra then [] when gone then ['only in chain'] when extra then ['only in ledger'] when broken then ['malformed column'] else found end) as problem from k")
def reconcile_record_keys(spark, d):
    n = F.col("doc_id")
    told = view(spark, d, "v_records").withColumns({
        "parser_config": F.concat(F.lit('{"model": "m'), (n % 3).cast("string"), F.lit('"}')), "manifest": F.concat(F.lit('{"document.md":"'), F.col("source_hash"), F.lit('"}')),
        "artifact_hash": canon.sha256(F.concat(F.lit("document.md\0"), F.col("source_hash"), F.lit("\0"))),
    })
    logged = commits.record_body(told.where(n % 41 != 9))
    created = logged.select((n * 2).alias("seq"), F.col("record_id").alias("subject"), F.lit("record.created").alias("kind"), "body")
    moves = F.create_map(*[F.lit(x) for k, v in ledger.REACHED.items() for x in (v, k)])
    moved = logged.where("state <> 'pending'").select((n * 2 + 1).alias("seq"), F.col("record_id").alias("subject"), F.try_element_at(moves, F.col("state")).alias("kind"), F.lit("{}").alias("body"))
    other = lambda c, when, value: F.when(when, value).otherwise(F.col(c))
    actual = told.where(n % 37 != 8).withColumns({
        "artifact_hash": other("artifact_hash", n % 13 == 2, canon.sha256(F.col("run_id"))), "parser_version": other("parser_version", n % 19 == 4, F.lit("9")),
        "parser_config": F.when(n % 23 == 5, F.lit("{")).when(n % 43 == 6, F.lit('{"model":"x"}')).otherwise(F.col("parser_config")), "run_conditions": other("run_conditions", n % 29 == 6, F.lit('{"cpus":9}')),
        "run_id": other("run_id", n % 11 == 1, F.lit("another")), "source_hash": other("source_hash", n % 17 == 3, F.lit("another")), "state": other("state", n % 31 == 7, F.lit("another")),
        "manifest": other("manifest", n % 47 == 10, F.lit('{"document.md":"x"}')),
    })
    return ledger.record_differences(created.unionByName(moved), actual)


@query("""select dispatch_id from (select dispatch_id, string_agg(event || coalesce(attempt_id, '-'), ',' order by event_id) as e, string_agg(case when event_id % 101 = 0 then 'intent' else event end || coalesce(attempt_id, '-'), ',' order by event_id) as a from v_delivery_events group by 1) where e <> a""")
def reconcile_deliveries(spark, d):
    events = view(spark, d, "v_delivery_events")
    actual = events.withColumn("event", F.when(F.col("event_id") % 101 == 0, "intent").otherwise(F.col("event")))
    return chain.reconcile_lists(events, actual, "dispatch_id", "event_id", ("event", "attempt_id"))


@query("""select replay_id, 'only in ledger' as problem from v_replays where doc_id % 40 = 1 union all select replay_id, 'only in chain' from v_replays where doc_id % 40 = 2
union all select replay_id, 'outcome' from v_replays where doc_id % 40 = 3""")
def reconcile_replays(spark, d):
    both = view(spark, d, "v_replays").select("doc_id", "replay_id", F.lit("reproduced").alias("outcome"))
    actual = both.where("doc_id % 40 <> 2").withColumn("outcome", F.when(F.col("doc_id") % 40 == 3, "diverged").otherwise(F.col("outcome")))
    return chain.reconcile(both.where("doc_id % 40 <> 1"), actual, "replay_id", ("outcome",))


# Delivery.

_MAPPED = "case {} when 'intent' then 'intended' when 'receipt' then 'delivered' when 'failure' then 'failed' when 'removal_intent' then 'removing' when 'removal_receipt' then 'removed' when 'removal_failure' then 'removal_failed' end"


@query(f"select v.dispatch_id, coalesce({_MAPPED.format('e')}, 'not_attempted') as status from v_deliveries v left join (select dispatch_id, arg_max(event, event_id) as e from v_delivery_events group by 1) using (dispatch_id)")
def delivery_status(spark, d):
    return delivery.status(view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events"))


@query("""select dispatch_id, arg_min(chunks_digest, event_id) filter (event = 'intent') as chunks_digest, coalesce(arg_min(planned, event_id) filter (event = 'intent'), 0) as planned from v_delivery_events group by 1""")
def delivery_bound(spark, d):
    return delivery.bound(view(spark, d, "v_delivery_events"))


@query("select dispatch_id, arg_max(error, event_id) as error from v_delivery_events where event in ('failure', 'removal_failure') group by 1")
def delivery_last_error(spark, d):
    return delivery.last_error(view(spark, d, "v_delivery_events"))


_WRITTEN = """r as (select dispatch_id, coalesce(max(case when event = 'removal_receipt' then event_id end), -1) as removed, max(case when event = 'receipt' or (event = 'failure' and (done is null or done <> 0)) then event_id end) as wrote from v_delivery_events group by 1),
a as (select dispatch_id, bool_or(l = 'intent') as open from (select dispatch_id, attempt_id, arg_max(event, event_id) as l from v_delivery_events where event in ('intent', 'receipt', 'failure') group by 1, 2) group by 1),
n as (select dispatch_id, event_id, event, lag(event) over (partition by dispatch_id order by event_id) as p from v_delivery_events where event in ('intent', 'receipt', 'failure') and attempt_id is null),
g as (select dispatch_id, max(event_id) as again from n where event = 'intent' and p = 'intent' group by 1),
w as (select dispatch_id, coalesce(wrote > removed, false) or coalesce(again > removed, false) or coalesce(open, false) as possibly_written from r left join a using (dispatch_id) left join g using (dispatch_id))"""


@query(f"with {_WRITTEN} select dispatch_id, possibly_written from w")
def delivery_possibly_written(spark, d):
    return delivery.possibly_written(view(spark, d, "v_delivery_events"))


@query(f"""with {_WRITTEN}, s as (select v.dispatch_id, coalesce({_MAPPED.format('e')}, 'not_attempted') as status from v_deliveries v left join (select dispatch_id, arg_max(event, event_id) as e from v_delivery_events group by 1) using (dispatch_id)),
x as (select dispatch_id, arg_max(error, event_id) as error from v_delivery_events where event in ('failure', 'removal_failure') group by 1)
select dispatch_id, case status when 'not_attempted' then 'nothing was sent' when 'delivered' then 'the target confirmed the write'
  when 'removed' then (case when coalesce(possibly_written, false) then 'removed, but another attempt may have written' else 'removed from the target' end)
  when 'failed' then (case when coalesce(possibly_written, false) then 'failed, and may have been written in part' else 'failed, nothing written' end) || coalesce(': ' || error, '')
  when 'removal_failed' then 'removal failed' || coalesce(': ' || error, '') when 'removing' then 'removal has no outcome yet' else 'the write has no outcome yet' end as explanation
from s left join w using (dispatch_id) left join x using (dispatch_id)""")
def delivery_explain(spark, d):
    return delivery.explain(view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events"))


@query(f"with {_WRITTEN} select v.dispatch_id, v.record_id from v_deliveries v join w using (dispatch_id) join v_records r on r.record_id = v.record_id where possibly_written and r.state = 'invalidated'")
def retract_set(spark, d):
    return delivery.retract_set(view(spark, d, "v_records"), view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events")).select("dispatch_id", "record_id")


@query("""with i as (select dispatch_id, event_id, chunks_digest, first_value(chunks_digest) over (partition by dispatch_id order by event_id) as f from v_delivery_events where event = 'intent')
select dispatch_id, event_id from i where chunks_digest <> f""")
def payload_conflicts(spark, d):
    return delivery.payload_conflicts(view(spark, d, "v_delivery_events"))


@query("""select record_id, 'chunks-v2:' || sha256('[' || string_agg('{"chunk_id":"' || chunk_id || '","content_hash":"' || content_hash || '","metadata":' || metadata || ',"token_count":' || token_count || '}', ',' order by ord) || ']') as digest from v_chunks group by 1""")
def payload_digest(spark, d):
    return delivery.payload_digest(view(spark, d, "v_chunks"))


@query("""select doc_id as chunk_id, sha256(text) as content_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint as token_count from documents""")
def chunk_build(spark, d):
    return delivery.make_chunks(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))).drop("content")


@query("""with b as (select *, row_number() over (partition by record_id, chunk_id order by ord) as nth from v_chunks),
x as (select record_id, ord, case when chunk_id = '' then 'empty id' when nth > 1 then 'duplicate id' when content = '' then 'empty content' when content_hash = '' then 'empty hash' when content_hash <> sha256(content) then 'wrong hash' when token_count < 0 then 'token count' when metadata = '{' then 'metadata' end as v from b),
f as (select record_id, arg_min(v, ord) filter (v is not null) as violation, count(*) as n from x group by 1)
select r.record_id, case when n is null then 'no chunks' else violation end as violation from v_records r left join f using (record_id) where n is null or violation is not null""")
def chunk_violations(spark, d):
    return delivery.chunk_violations(view(spark, d, "v_records"), view(spark, d, "v_chunks"))


@query("""select dispatch_id, arg_max(event, event_id) = 'receipt' as submitted, arg_max(struct_pack(x := done), event_id).x as written, case when arg_max(event, event_id) = 'failure' then arg_max(struct_pack(x := error), event_id).x end as error
from v_delivery_events where event in ('receipt', 'failure') group by 1""")
def dispatch_results(spark, d):
    return delivery.results(view(spark, d, "v_delivery_events"))


# Conversations.

_TREE = """with recursive n as (select *, coalesce(parent, '-') as up from v_conv_nodes), k as (select conv_id, parent as node_id, count(*) as kids from v_conv_nodes where parent is not null group by 1, 2),
l as (select *, case when conv_id::bigint % 2 = 0 then -ord else ord end as key from n),
p as (select *, row_number() over (partition by conv_id, up order by key) - 1 as place, count(*) over (partition by conv_id, up) as among from l),
t as (select conv_id, node_id, 0 as depth, place, 1::bigint as among, text, null::varchar as above, [key] as path from p where parent is null
  union all select p.conv_id, p.node_id, t.depth + 1, p.place, p.among, p.text, case when t.text <> '' then t.node_id else t.above end, list_append(t.path, p.key) from p join t on p.conv_id = t.conv_id and p.parent = t.node_id),
c as (select conv_id, count(*) as node_count, count(*) filter (node_id not in (select node_id from k where k.conv_id = v.conv_id)) as branch_count from v_conv_nodes v group by 1)"""


@query(_TREE + """ select t.conv_id, t.node_id, (row_number() over (partition by t.conv_id order by path) - 1)::bigint as ord, depth::int as depth, place::int as sibling_index, among::int as sibling_count, coalesce(kids, 0)::int as child_count, kids is null as is_leaf,
  above as parent_node_id, false as on_current_branch, node_count::int as node_count, branch_count::int as branch_count, text, null::varchar as problem from t join c using (conv_id) left join k using (conv_id, node_id)""")
def conv_flatten(spark, d):
    """Children in the order of their lists: last first in half of the conversations, with ids that name no node in some."""
    return conversations.flatten(_listed(spark, d))


def _listed(spark, d):
    nodes = view(spark, d, "v_conv_nodes")
    number = F.col("conv_id").cast("long")
    below = nodes.where("parent is not null").groupBy("conv_id", F.col("parent").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("c"))
    ids = F.transform("c", lambda x: x["node_id"])
    ids = F.when(number % 2 == 0, F.reverse(ids)).otherwise(ids)
    return nodes.join(below.select("conv_id", "node_id", F.when(number % 3 == 0, F.concat(F.array(F.lit("gone")), ids, F.array(F.lit("lost")))).otherwise(ids).alias("children")), ["conv_id", "node_id"], "left")


@query("""with c as (select conv_id, conv_id::bigint % 4 as kind, count(*) as n, count(*) filter (parent = 'n0') as under from v_conv_nodes group by 1)
select conv_id, case when kind = 0 and under > 0 then 'reached twice' when kind = 1 then 'children are no list' when kind = 2 then 'reached twice' when kind = 3 and n > 1 then 'cycle' end as problem from c""")
def conv_malformed_lists(spark, d):
    """A child listed twice, children that are no list, a root that lists itself, nodes that no list names."""
    kind, root = F.col("conv_id").cast("long") % 4, F.col("ord") == 0
    listed = F.coalesce("children", F.array().cast("array<string>"))
    spoiled = F.when((kind == 0) & root, F.concat(listed, listed)).when((kind == 2) & root, F.concat(listed, F.array("node_id"))).when(kind != 3, F.col("children"))
    nodes = _listed(spark, d).withColumns({"children": spoiled, "children_ok": (kind != 1) | ~root})
    return conversations.flatten(nodes).select("conv_id", "problem").distinct()


@query("""with k as (select conv_id, parent from v_conv_nodes where parent is not null)
select conv_id, count(*) as node_count, count(*) filter (not exists (select 1 from k where k.conv_id = v.conv_id and k.parent = v.node_id)) as branch_count from v_conv_nodes v group by 1""")
def conv_branches(spark, d):
    return conversations.branch_counts(view(spark, d, "v_conv_nodes"))


@query("""with recursive l as (select conv_id, arg_max(node_id, ord) as node_id from v_conv_nodes group by 1),
b as (select l.conv_id, l.node_id, parent from l join v_conv_nodes using (conv_id, node_id) union select v.conv_id, v.node_id, v.parent from v_conv_nodes v join b on v.conv_id = b.conv_id and v.node_id = b.parent)
select conv_id, node_id from b""")
def conv_current_branch(spark, d):
    nodes = view(spark, d, "v_conv_nodes")
    current = nodes.groupBy("conv_id").agg(F.max_by("node_id", "ord").alias("current_node"))
    return conversations.flatten(nodes, current).where("on_current_branch").select("conv_id", "node_id")


@query("""select conv_id, case when conv_id::bigint % 3 = 0 then 'reached twice' when conv_id::bigint % 3 = 1 then 'cycle' else 'unknown current node' end as problem from (select distinct conv_id from v_conv_nodes)""")
def conv_malformed(spark, d):
    nodes = view(spark, d, "v_conv_nodes")
    kind = F.col("conv_id").cast("long") % 3
    twice = nodes.where((kind == 0) & (F.col("ord") == 0))
    loop = nodes.where((kind == 1) & (F.col("ord") == 0)).select("conv_id", F.lit(10_000).cast("long").alias("ord"), F.lit("x").alias("node_id"), F.lit("y").alias("parent"), "role", "text")
    back = loop.select("conv_id", (F.col("ord") + 1).alias("ord"), F.lit("y").alias("node_id"), F.lit("x").alias("parent"), "role", "text")
    current = nodes.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id").cast("long") % 3 == 2, "nowhere").alias("current_node"))
    return conversations.flatten(nodes.unionByName(twice).unionByName(loop).unionByName(back), current).select("conv_id", "problem").distinct()


@query("""with c as (select distinct conv_id::bigint as index, case when conv_id::bigint % 4 = 0 then '' when conv_id::bigint % 4 = 1 then 'same' else conv_id end as own from v_conv_nodes), i as (select index, case when own = '' then 'conversation-' || printf('%06d', index) else own end as own from c)
select index, own || case when row_number() over (partition by own order by index) > 1 then '#' || row_number() over (partition by own order by index) else '' end as conv_id from i""")
def conv_dup_ids(spark, d):
    ids = view(spark, d, "v_conv_nodes").select(F.col("conv_id").cast("long").alias("index"), "conv_id").distinct()
    own = F.when(F.col("index") % 4 == 0, "").when(F.col("index") % 4 == 1, "same").otherwise(F.col("conv_id"))
    return conversations.conversation_ids(ids.select("index", own.alias("conversation_id"), F.lit(None).cast("string").alias("id"))).select("index", "conv_id")


@query("""select conv_id, turn, trim(case role when 'system' then '[image_asset_pointer: file-' || turn || ']' || chr(10) || chr(10) || text else text end, ' ' || chr(9) || chr(10) || chr(13)) as text from conversations""")
def conv_render(spark, d):
    quoted = canon.quote_json(F.col("text"))
    parts = F.when(F.col("role") == "system", F.concat(F.lit('[{"content_type":"image_asset_pointer","asset_pointer":"file-'), F.col("turn").cast("string"), F.lit('"},'), quoted, F.lit("]"))).otherwise(F.concat(F.lit('["",'), quoted, F.lit("]")))
    content = F.when(F.col("role") == "user", F.concat(F.lit('{"content_type":"code","text":'), quoted, F.lit("}"))).otherwise(F.concat(F.lit('{"content_type":"multimodal_text","parts":'), parts, F.lit("}")))
    return read(spark, d, "conversations").select("conv_id", "turn", conversations.render(content).alias("text"))


@query("""with e as (select conv_id, turn, '{"t":' || to_json(text) || '}' as x from conversations), o as (select conv_id as key, row_number() over w - 1 as i, octet_length(encode(x)) as n, sum(octet_length(encode(x)) + 1) over (partition by conv_id order by turn rows unbounded preceding) as s from e window w as (partition by conv_id order by turn))
select key, i as index, 'conversations/' || printf('%06d', i) || '.json' as path, (s - n)::bigint as "offset", n::bigint as length, null::varchar as error from o""")
def export_split(spark, d):
    element = F.concat(F.lit('{"t":'), canon.quote_json(F.col("text")), F.lit("}"))
    items = read(spark, d, "conversations").select("conv_id", F.struct("turn", element.alias("x")).alias("e")).groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list("e")).alias("all"))
    files = items.select("key", F.concat(F.lit("["), F.array_join(F.transform("all", lambda e: e["x"]), ","), F.lit("]")).cast("binary").alias("content"))
    return conversations.export_elements(files)


# Markdown units and anchors.

_MD = """array_join(transform(split(text, '\n'), (l, i) -> case i % 5 when 0 then concat(repeat('#', 1 + i % 6), ' ', l) when 1 then concat('- ', l) when 2 then concat('```\n', l, '\n\n```') else case i % 15 when 3 then concat(l, '\n=====') when 8 then concat('| ', l, ' |') when 13 then concat('$$ ', l, ' $$') when 9 then concat('![', l, '](f.png)') else l end end), '\n\n')"""
_MD_UNITS = """with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as i from documents),
b as (select doc_id, i, case i % 5 when 0 then repeat('#', (1 + i % 6)::int) || ' ' || x when 1 then '- ' || x when 2 then '```' || chr(10) || x || chr(10) || chr(10) || '```' else (case i % 15 when 3 then x || chr(10) || '=====' when 8 then '| ' || x || ' |' when 13 then '$$ ' || x || ' $$' when 9 then '![' || x || '](f.png)' else x end) end as text,
  case i % 5 when 0 then 'heading' when 1 then 'list' when 2 then 'code' else (case i % 15 when 3 then 'heading' when 8 then 'table' when 13 then 'formula' when 9 then 'figure' else 'paragraph' end) end as kind, case when i % 5 = 0 then (1 + i % 6)::int when i % 15 = 3 then 1 end as level from l),
o as (select *, sum(octet_length(encode(text)) + 2) over (partition by doc_id order by i rows unbounded preceding) - 2 as e from b),
u as (select doc_id, i, kind, level, text, (e - octet_length(encode(text)))::bigint as s, e::bigint as e, 'u' || printf('%06d', i + 1) as unit_id from o)"""


def _markdown(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.expr(_MD).cast("binary").alias("content"))


@query(_MD_UNITS + " select doc_id as key, i::int as ord, s as start, e as \"end\", sha256(text) as digest from u")
def md_blocks(spark, d):
    return markdown.blocks(_markdown(spark, d)).select("key", "ord", "start", "end", F.sha2("block", 256).alias("digest"))


@query(_MD_UNITS + " select kind, level, count(*) as n from u group by 1, 2")
def md_kinds(spark, d):
    return markdown.normalise(_markdown(spark, d)).groupBy("kind", "level").agg(F.count("*").alias("n"))


@query(_MD_UNITS + """ select doc_id as key, unit_id, (select arg_max(h.unit_id, h.i) from u h where h.doc_id = u.doc_id and h.i < u.i and h.level < coalesce(u.level, 7)) as parent from u""")
def md_sections(spark, d):
    return markdown.normalise(_markdown(spark, d)).select("key", "unit_id", "parent")


def _anchored(spark, d):
    docs = _markdown(spark, d).withColumn("digest", F.sha2("content", 256))
    units = markdown.normalise(docs.select("key", "content")).join(docs.select("key", "digest"), "key")
    record = F.format_string("rec-%08d", F.col("key"))
    moved = F.when((F.col("key") % 17 == 0) & (F.col("ord") == 1), F.col("start") + 1).otherwise(F.col("start"))
    anchors = units.select(record.alias("record_id"), "unit_id", F.lit("document.md").alias("artifact"), F.when(F.col("key") % 19 == 0, F.lit("x")).otherwise(F.col("digest")).alias("digest"), moved.alias("start"), "end", "text", "ord", "kind", "level", "parent")
    manifest = docs.where("key % 23 <> 0").select(record.alias("record_id"), F.lit("document.md").alias("path"), "digest")
    blobs = docs.where("key % 29 <> 0").select("digest", "content").dropDuplicates(["digest"])
    return anchors, manifest, blobs


@query("""with d as (select *, row_number() over (partition by text order by (doc_id % 29 = 0)::int) = 1 and doc_id % 29 <> 0 as any from documents), stored as (select text from documents where doc_id % 29 <> 0 group by text),
""" + _MD_UNITS[5:] + """, p as (select u.*, case when doc_id % 23 = 0 then 'not in the bundle' when doc_id % 19 = 0 then 'digest differs' when (select d2.text from documents d2 where d2.doc_id = u.doc_id) not in (select text from stored) then 'no blob' when doc_id % 17 = 0 and i = 1 then 'text differs' end as problem from u)
select problem, count(*) as n from p group by 1""")
def anchor_resolve(spark, d):
    anchors, manifest, blobs = _anchored(spark, d)
    return markdown.resolve(anchors, manifest, blobs).groupBy("problem").agg(F.count("*").alias("n"))


@query(_MD_UNITS + """ select 'rec-' || printf('%08d', doc_id) as record_id, unit_id, unnest(case when doc_id % 31 = 0 then (case when i = 0 then ['kind', 'level'] else ['kind'] || (case when level is not null then ['level'] else [] end) end) else [] end) as problem from u""")
def extraction_problems(spark, d):
    anchors, _, _ = _anchored(spark, d)
    bad = F.when(F.substring("record_id", 5, 8).cast("long") % 31 == 0, "unknown").otherwise(F.col("kind"))
    return markdown.extraction_problems(anchors.withColumn("kind", bad).withColumn("start", F.lit(None).cast("long")))


@query("""select doc_id as key, case when doc_id % 7 = 0 then 'not UTF-8' end as error, case when doc_id % 7 = 0 then 1 else len(string_split(text, chr(10))) end as n from documents""")
def md_errors(spark, d):
    """Documents of which some end in a byte that is no UTF-8: no units and one row with the error."""
    spoiled = F.when(F.col("key") % 7 == 0, F.concat("content", F.lit(b"\n\nok\n\n\xff"))).otherwise(F.col("content"))
    units = markdown.normalise(_markdown(spark, d).select("key", spoiled.alias("content")))
    return units.groupBy("key", "error").agg(F.count("*").alias("n"))


@query("""with e as (select record_id, doc_id, parser_name, list_filter([case when doc_id % 5 = 0 then 'another record' end, case when doc_id % 6 = 0 then 'another output' end, case when doc_id % 7 = 0 then 'another source' end, case when doc_id % 9 = 0 then 'another parser' end,
  case when parser_name = 'probe' then 'no normaliser' end, case when parser_name <> 'probe' and doc_id % 11 = 0 then 'another normaliser' end], lambda x: x is not null) as found from v_records)
select record_id, unnest(found) as problem from e union all select 'gone-' || doc_id, 'no record' from v_records where doc_id % 13 = 0""")
def extraction_headers(spark, d):
    n = F.col("doc_id")
    records = view(spark, d, "v_records")
    changed = lambda c, k: F.when(n % k == 0, F.lit("x")).otherwise(c)
    said = records.select(
        "doc_id", "record_id", changed(F.col("record_id"), 5).alias("of_record"), changed(F.col("artifact_hash"), 6).alias("artifact_hash"), changed(F.col("source_hash"), 7).alias("source_hash"),
        changed(F.concat_ws("@", "parser_name", "parser_version"), 9).alias("parser"), changed(markdown.normaliser(F.col("parser_name")), 11).alias("normaliser"),
    )
    gone = said.where(n % 13 == 0).withColumn("record_id", F.concat(F.lit("gone-"), n.cast("string")))
    return markdown.header_problems(said.unionByName(gone), records)


@query("""select event_id, '/props/' || replace(replace(event_type || '~' || props, '~', '~0'), '/', '~1') as pointer from events""")
def json_pointer_build(spark, d):
    return read(spark, d, "events").select("event_id", canon.json_pointer(F.lit("props"), F.concat("event_type", F.lit("~"), "props")).alias("pointer"))


@query()
def json_pointer_resolve(spark, d):
    document = F.concat(F.lit('{"a/b":['), F.col("props"), F.lit(","), F.col("event_id").cast("string"), F.lit("]}"))
    return read(spark, d, "events").select("event_id", markdown.pointer_value(document, F.lit("/a~1b/1")).alias("value"))


# References.

_REFS = """r as (select record_id, source_hash, artifact_hash, created_at, doc_id from v_records),
f as (select doc_id, 'provenir:record:' || record_id || '@' || artifact_hash as ref, 'record' as type, record_id as id, artifact_hash as digest from r
  union all select doc_id, 'provenir:snapshot:file:' || source_hash, 'snapshot', 'file', source_hash from r
  union all select doc_id, 'provenir:source:' || source_hash, 'source', null, source_hash from r
  union all select doc_id, 'provenir:event:' || (doc_id + 1) || '@' || source_hash, 'event', (doc_id + 1)::varchar, source_hash from r
  union all select doc_id, 'provenir:anchor:' || record_id || '@' || artifact_hash || '/out%20put/a%C3%A9.md@' || source_hash || '#bytes=0-' || doc_id, 'anchor', record_id, artifact_hash from r)"""


def _refs(spark, d):
    r = view(spark, d, "v_records")
    n, nothing = F.col("doc_id"), F.lit(None).cast("string")
    made = {
        "record": refs.record_ref(F.col("record_id"), F.col("artifact_hash")), "snapshot": refs.snapshot_ref(F.lit("file"), F.col("source_hash")), "source": refs.source_ref(F.col("source_hash")),
        "event": refs.event_ref(n + 1, F.col("source_hash")), "anchor": refs.anchor_ref(F.col("record_id"), F.col("artifact_hash"), F.lit("out put/aé.md"), F.col("source_hash"), F.lit(0), n, nothing, nothing),
    }
    return r.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("ref")) for k, v in made.items()])).alias("x")).select("doc_id", "x.*")


@query(f"with {_REFS} select doc_id, type, ref from f")
def ref_format(spark, d):
    return _refs(spark, d)


@query(f"with {_REFS}, c as (select doc_id, case when doc_id % 5 = 0 then ref || ' ' when doc_id % 5 = 1 then upper(ref) else ref end as ref, type, id, digest from f) select ref, case when doc_id % 5 > 1 then type end as type, case when doc_id % 5 > 1 then id end as id, case when doc_id % 5 > 1 then digest end as digest from c")
def ref_parse(spark, d):
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("ref", F.lit(" "))).when(F.col("doc_id") % 5 == 1, F.upper("ref")).otherwise(F.col("ref"))
    return _refs(spark, d).select(changed.alias("ref")).withColumn("p", refs.parse_ref(F.col("ref"))).select("ref", "p.type", "p.id", "p.digest")


@query("""select record_id, sha256('{"observed_at":"' || created_at || '","record_id":"' || record_id || '","schema":"provenir.observation","schema_version":1,"snapshot":{"digest":"' || source_hash || '","kind":"file"},"source_id":null}') as digest from v_records""")
def observation_digest(spark, d):
    return view(spark, d, "v_records").select("record_id", refs.observation_digest(F.col("record_id"), F.lit(None).cast("string"), F.col("source_kind"), F.col("source_hash"), F.col("created_at")).alias("digest"))


# Comparison and replay.


@query("""select event_id as key, '/value' as path, value || ' and ' || (value + case when event_id % 3 = 0 then 0.5::double else 0.001::double end) || ' are too far apart' as finding from events where event_id % 3 = 0""")
def json_tolerance(spark, d):
    text = lambda v: F.concat(F.lit('{"at":'), F.col("event_id").cast("string"), F.lit(',"value":'), v.cast("string"), F.lit("}"))
    moved = F.col("value") + F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.001)
    pairs = read(spark, d, "events").select(F.col("event_id").alias("key"), F.lit("out.json").alias("name"), text(F.col("value")).alias("a"), text(moved).alias("b"))
    policy = compare.JsonPolicy(keys={"value": compare.Tolerance(abs=0.01)}, ignore=frozenset({"at"}))
    return compare.json_findings(pairs, policy)


@query("""select event_id as key, unnest(list_filter([case when event_id % 4 = 0 then 'b.bin' end, case when event_id % 5 = 0 then 'new.txt' end, case when event_id % 3 = 0 then 'a.json/v' end, case when event_id % 7 = 0 then 'c.bin' end], lambda x: x is not null)) as path,
  unnest(list_filter([case when event_id % 4 = 0 then 'only recorded' end, case when event_id % 5 = 0 then 'only replayed' end, case when event_id % 3 = 0 then event_id || ' is not ' || (event_id + 1) end, case when event_id % 7 = 0 then 'other bytes' end], lambda x: x is not null)) as finding from events""")
def policy_file_sets(spark, d):
    """Two sets of files for each event: one goes, one comes, JSON differs in a number or in layout alone, other bytes differ."""
    n = F.col("event_id")
    number = lambda v: F.concat(F.lit('{"v":'), v.cast("string"), F.lit("}"))
    sides = {
        "recorded": {"a.json": number(n), "b.bin": F.lit("b"), "c.bin": F.lit("c"), "d.json": F.lit('{"x":1,"y":[1.0]}')},
        "replayed": {"a.json": number(F.when(n % 3 == 0, n + 1).otherwise(n)), "b.bin": F.when(n % 4 != 0, "b"), "c.bin": F.when(n % 7 == 0, "C").otherwise("c"), "d.json": F.lit('{"y": [1.0], "x": 1}'), "new.txt": F.when(n % 5 == 0, "new")},
    }
    events = read(spark, d, "events").select(n.alias("key"), n)
    files = {k: events.select("key", F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("path"), c.alias("content")) for p, c in v.items()]), lambda x: x["content"].isNotNull())).alias("f")).select("key", "f.path", "f.content").withColumn("digest", canon.sha256(F.col("content"))) for k, v in sides.items()}
    blobs = files["recorded"].unionByName(files["replayed"]).select("digest", "content").distinct()
    return compare.output_findings(files["recorded"], files["replayed"], blobs, compare.JsonPolicy())


@query("select replay_id, cast(doc_id as varchar) as replayed_at from v_replays where doc_id % 10 = 8")
def replays_by_outcome(spark, d):
    replays = view(spark, d, "v_replays").select("replay_id", F.col("doc_id").cast("string").alias("replayed_at"), F.col("state").alias("outcome"))
    return compare.replays_of(replays, outcome="invalidated").select("replay_id", "replayed_at")


@query("select replay_id, parser_name is not null and doc_id % 3 = 0 as in_catalog from v_replays")
def parser_catalogue(spark, d):
    specs = compare.catalogue(spark.createDataFrame([("mineru", "0"), ("marker", "0")], "name string, version string"))
    return compare.in_catalogue(view(spark, d, "v_replays").withColumn("parser_version", (F.col("doc_id") % 3).cast("string")), specs).select("replay_id", "in_catalog")


@query("""select vec_id as key, len(embedding)::int as compared, len(list_filter(embedding, lambda x: not (abs(x::double - (x::double + vec_id % 5 * 0.0001::double)) <= greatest(0.001::double * greatest(abs(x::double), abs(x::double + vec_id % 5 * 0.0001::double)), 0.00015::double))))::int as beyond,
  len(list_filter(embedding, lambda x: not (abs(x::double - (x::double + vec_id % 5 * 0.0001::double)) <= greatest(0.001::double * greatest(abs(x::double), abs(x::double + vec_id % 5 * 0.0001::double)), 0.00015::double)))) = 0 as close from embeddings""")
def float_tolerance(spark, d):
    pairs = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("a"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.col("vec_id") % 5 * F.lit(0.0001)).alias("b"))
    return compare.vectors_close(pairs, 0.001, 0.00015)


@query("""with r as (select *, case when state not in ('sealed', 'invalidated') then 'refused' when parser_name is null then 'no parser identity' when not in_catalog then 'not in the catalog' when not conditions_ok then 'conditions unusable'
  when not deterministic and not has_policy then 'not deterministic and no policy' when not module_ok then 'module differs' when not input_ok then 'input unavailable' when not config_ok then 'config can''t be built' when not backend_ok then 'no capable backend' when not measured_ok then 'measured digest differs' end as reason from v_replays)
select replay_id, reason, case when reason = 'refused' then 'refused' when reason is not null then 'unreplayable' when not succeeded then 'failed' when differences = 0 and deterministic then 'reproduced' when has_policy then (case when policy_accepts then 'equivalent' else 'diverged' end) else 'diverged' end as outcome from r""")
def replay_outcome(spark, d):
    return compare.replay_outcomes(view(spark, d, "v_replays")).select("replay_id", "reason", "outcome")


# Campaigns.


def _journal(spark, d):
    return view(spark, d, "v_journal"), view(spark, d, "v_doc_corpus")


_OUTCOMES = """b as (select * from v_journal where lane = 'base'), l as (select path, unnest(['cand_a', 'cand_b']) as lane from v_doc_corpus),
o as (select l.path, l.lane, case when b.status is null or c.status is null then 'incomplete' when 'error' in (b.status, c.status) then 'error' when b.status = 'not_applicable' and c.status = 'not_applicable' then 'not_applicable' when 'not_applicable' in (b.status, c.status) then 'failure_mismatch'
    when b.status = 'sealed' and c.status = 'sealed' then (case when b.artifact_hash = c.artifact_hash then 'identical' else 'diverged' end) when b.status = 'sealed' then 'regression' when c.status = 'sealed' then 'recovered' when b.reason is not distinct from c.reason then 'consistent_failure' else 'failure_mismatch' end as outcome,
    case when b.wall_time_seconds > 0 then c.wall_time_seconds / b.wall_time_seconds end as r
  from l left join v_journal c on c.path = l.path and c.lane = l.lane left join b on b.path = l.path)"""


@query("select path, lane from (select path, unnest(['base', 'cand_a', 'cand_b']) as lane from v_doc_corpus) w where not exists (select 1 from v_journal j where j.path = w.path and j.lane = w.lane)")
def campaign_pending(spark, d):
    journal, corpus = _journal(spark, d)
    lanes = spark.createDataFrame([(x, i) for i, x in enumerate(LANES)], "lane string, lane_order int")
    return campaign.pending(corpus, lanes, journal)


@query("select path, lane, status, line + 1 as line from v_journal")
def latest_observation(spark, d):
    journal, _ = _journal(spark, d)
    again = journal.withColumn("line", F.col("line") + 1)
    return campaign.latest(journal.withColumn("status", F.lit("error")).unionByName(again).select("path", "lane", "line", "status")).select("path", "lane", "status", "line")


@query(f"with {_OUTCOMES} select path, lane, outcome, case when outcome = 'identical' then r end as ratio from o")
def lane_outcomes(spark, d):
    journal, corpus = _journal(spark, d)
    return campaign.compare_lanes(corpus, journal, BASE, LANES[1:])


@query(f"""with {_OUTCOMES}, m as (select path, lane, case when lane = 'base' then doc_id % 6 else doc_id % 10 end = 0 as lost from v_journal)
select o.path, o.lane, case when outcome in ('identical', 'diverged') and (m.lost or n.lost) then 'error' else outcome end as outcome from o left join m on m.path = o.path and m.lane = o.lane left join m n on n.path = o.path and n.lane = 'base'""")
def lane_outcomes_recorded(spark, d):
    """Sealed observations of which some name a record that is not in the ledger."""
    journal, corpus = _journal(spark, d)
    named = journal.withColumn("record_id", F.concat("path", F.lit("@"), "lane"))
    lost = F.when(F.col("lane") == BASE, F.col("doc_id") % 6 == 0).otherwise(F.col("doc_id") % 10 == 0)
    return campaign.compare_lanes(corpus, named, BASE, LANES[1:], records=named.where(~lost).select("record_id")).select("path", "lane", "outcome")


@query("""select unnest(['lanes', 'parser', 'seed', 'started']) as field, unnest(['differs', 'missing', 'differs', 'unknown']) as problem where (select count(*) from v_doc_corpus) > 0""")
def journal_header(spark, d):
    """A journal resumed with another number of lanes, without its parser, with another seed and with a field of its own."""
    n = view(spark, d, "v_doc_corpus").agg(F.count("*").cast("string").alias("n"))
    fields = lambda **x: n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.concat(F.lit(v), "n").alias("value")) for k, v in x.items()])).alias("f")).select("f.*")
    return campaign.header_problems(fields(corpus="c", lanes="2", seed="1", started="t"), fields(corpus="c", lanes="3", parser="p", seed="2"))


@query(f"with {_OUTCOMES} select lane, count(*) as n, round(median(r), 6) as median_slowdown from o where outcome = 'identical' and r is not null group by 1")
def slowdown(spark, d):
    return campaign.slowdowns(lane_outcomes(spark, d))


@query(f"""with {_OUTCOMES}, v as (select * from v_waivers where trim(reason) <> '') select path, lane, outcome from o where outcome in ('incomplete', 'error', 'diverged', 'regression', 'failure_mismatch') and not exists (select 1 from v where v.path = o.path and v.lane = o.lane and v.outcome = o.outcome)""")
def waivers(spark, d):
    unwaived, _ = campaign.apply_waivers(lane_outcomes(spark, d), view(spark, d, "v_waivers"))
    return unwaived.select("path", "lane", "outcome")


@query(f"with {_OUTCOMES} select path, lane, outcome from v_waivers w where not exists (select 1 from o where w.path = o.path and w.lane = o.lane and w.outcome = o.outcome)")
def unused_waivers(spark, d):
    _, unused = campaign.apply_waivers(lane_outcomes(spark, d), view(spark, d, "v_waivers"))
    return unused.select("path", "lane", "outcome")


@query("select lane, status, count(*) as n from v_journal group by 1, 2")
def lane_statuses(spark, d):
    return campaign.lane_statuses(view(spark, d, "v_journal"))


@query("select lane, coalesce(reason, 'unknown') as reason, count(*) as n from v_journal where status = 'failed' group by 1, 2")
def failure_reasons(spark, d):
    return campaign.failure_reasons(view(spark, d, "v_journal"))


@query("select lane, count(wall_time_seconds) as n, round(quantile_disc(wall_time_seconds, 0.5), 6) as p50, round(quantile_disc(wall_time_seconds, 0.95), 6) as p95, round(max(wall_time_seconds), 6) as max from v_journal group by 1")
def lane_stats(spark, d):
    return campaign.lane_stats(view(spark, d, "v_journal"))


@query("select record_id, path, lane from v_journal qualify row_number() over (partition by record_id order by doc_id, lane_order) > 1")
def double_claims(spark, d):
    return campaign.double_claims(view(spark, d, "v_journal"))


@query(f"""with {_OUTCOMES}, v as (select * from v_waivers where trim(reason) <> ''), j as (select * from v_journal), s as (select lane, round(median(r), 6) as m from o where outcome = 'identical' and r is not null group by 1),
x as (select (select count(*) from v_doc_corpus)::double as docs, (select count(*) from (select path, unnest(['base', 'cand_a', 'cand_b']) as lane from v_doc_corpus) w where not exists (select 1 from j where j.path = w.path and j.lane = w.lane))::double as missing,
  (select count(*) from b where status = 'sealed')::double as sealed, (select count(*) from b where status = 'failed')::double as failed, (select count(*) from b where status <> 'not_applicable')::double as applicable, (select count(*) from j where status = 'error')::double as errors,
  (select count(*) from o where outcome in ('incomplete', 'error', 'diverged', 'regression', 'failure_mismatch') and not exists (select 1 from v where v.path = o.path and v.lane = o.lane and v.outcome = o.outcome))::double as unwaived,
  (select count(*) from v_waivers w where not exists (select 1 from o where w.path = o.path and w.lane = o.lane and w.outcome = o.outcome))::double as unused, (select count(*) from s where m > 1.15::double)::double as slow,
  (select count(*) from v_corpus a full join v_present b on a.path = b.path where a.digest is distinct from b.digest)::double as changed, (select count(*) from v_journal where doc_id % 6 = 0 and status = 'sealed')::double as unsound,
  (select count(*) from v_states where record_id like 'rec-%7')::double as chain, (select count(*) from v_replays where doc_id % 40 = 1)::double as replays)
select 'corpus_unchanged' as gate, changed = 0 as passed, changed as value from x union all select 'records_verified', unsound = 0, unsound from x union all select 'ledger_verified', chain + replays = 0, chain + replays from x
union all select 'coverage' as gate, missing = 0 and docs > 0 as passed, missing as value from x union all select 'baseline_produced_output', sealed > 0, sealed from x union all select 'no_errors', errors = 0, errors from x
union all select 'candidates_agree', unwaived = 0, unwaived from x union all select 'waivers_used', unused = 0, unused from x union all select 'baseline_failure_rate', failed / applicable <= 0.1::double, failed / applicable from x union all select 'slowdown', slow = 0, slow from x""")
def gates(spark, d):
    journal, corpus = _journal(spark, d)
    compared = lane_outcomes(spark, d)
    unwaived, unused = campaign.apply_waivers(compared, view(spark, d, "v_waivers"))
    told = [view(spark, d, "v_states").where("record_id like 'rec-%7'"), view(spark, d, "v_replays").where("doc_id % 40 = 1")]
    return campaign.gates(corpus, LANES, BASE, journal, compared, unwaived, unused, 0.1, 1.15, corpus_drift(spark, d), journal.where("doc_id % 6 = 0 and status = 'sealed'"), told)


@query("""select signoff_id, s.record_id, case when r.state is null then 'gone' when r.state <> 'sealed' then 'is ' || r.state else 'other contents' end as problem from v_signoffs s left join v_records r using (record_id) where r.state is null or r.state <> 'sealed' or r.artifact_hash <> s.artifact_hash""")
def signoff_stale(spark, d):
    return campaign.stale_signoffs(view(spark, d, "v_signoffs"), view(spark, d, "v_records"))


@query("""select doc_id as signoff_id, case when doc_id % 5 = 2 then 'head missing' else 'head differs' end as problem from documents where doc_id > 0 and (doc_id % 5 = 2 or doc_id % 7 = 3)""")
def signoff_heads(spark, d):
    docs = read(spark, d, "documents").select("doc_id", canon.sha256(F.col("text")).alias("hash"))
    heads = docs.select(F.col("doc_id").alias("signoff_id"), F.col("doc_id").alias("head_seq"), F.when(F.col("doc_id") % 7 == 3, "x").otherwise(F.col("hash")).alias("head_hash"))
    return campaign.lost_heads(heads, docs.where("doc_id % 5 <> 2").select(F.col("doc_id").alias("seq"), "hash"))


# Failures and backends.


@query("""select run_id, case when backend = 'bubblewrap' then (case when timed_out then 'timeout' when syscall_filter and exit_code = 159 then 'syscall_blocked' when exit_code between 129 and 192 or exit_code < 0 then 'crashed' when exit_code <> 0 then 'exit_status' end)
  when backend like 'oci%' then (case when timed_out or (exit_code = 137 and seconds >= timeout_seconds - 0.5) then 'timeout' when exit_code = 137 then 'out_of_memory' when exit_code between 125 and 127 then 'engine_error' when exit_code between 129 and 192 then 'crashed' when exit_code <> 0 then 'exit_status' end)
  when backend = 'wasmtime' then (case when timed_out or trap = 'interrupt' then 'timeout' when trap = 'fuel' then 'cpu_limit' when trap = 'link' then 'engine_error' when trap is not null and memory >= memory_cap then 'out_of_memory' when trap is not null then 'crashed' when exit_code <> 0 then 'exit_status' end)
  else (case when timed_out then 'timeout' when exit_code < 0 then 'crashed' when exit_code <> 0 then 'exit_status' end) end as failure from v_runs""")
def failure_classify(spark, d):
    return failures.classify(view(spark, d, "v_runs")).select("run_id", "failure")


@query("""select doc_id as need_id, case doc_id % 4 when 0 then 'bubblewrap' when 1 then 'oci-runc' when 2 then null else null end as backend, case doc_id % 4 when 0 then 'selected' when 1 then 'selected' when 2 then 'capable but unavailable' else 'unsupported' end as verdict from documents""")
def backend_select(spark, d):
    needed = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("filesystem"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("filesystem"), F.lit("memory"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("deterministic"))).otherwise(F.array(F.lit("teleport")))
    offers = [("bubblewrap", 0, ["filesystem", "network"], True), ("oci-runc", 1, ["filesystem", "network", "memory", "gpu"], True), ("wasmtime", 2, ["filesystem", "deterministic"], False)]
    return failures.select_backend(read(spark, d, "documents").select(F.col("doc_id").alias("need_id"), needed.alias("needed")), spark.createDataFrame(offers, "backend string, rank int, capabilities array<string>, available boolean"))


@query("""select doc_id, case when doc_id % 2 = 0 then 'podman' else 'docker' end as engine, '5.' || doc_id % 7 as version, doc_id % 3 = 0 as rootless, 'v2' as cgroup from documents""")
def engine_info(spark, d):
    n, three = (F.col("doc_id") % 7).cast("string"), F.col("doc_id") % 3 == 0
    podman = F.concat(F.lit('{"host":{"cgroupVersion":"v2","security":{"rootless":'), three.cast("string"), F.lit('}},"version":{"Version":"5.'), n, F.lit('"}}'))
    docker = F.concat(F.lit('{"ServerVersion":"5.'), n, F.lit('","CgroupVersion":"v2","SecurityOptions":['), F.when(three, '"name=rootless"').otherwise('"name=seccomp"'), F.lit("]}"))
    info = F.when(F.col("doc_id") % 2 == 0, podman).otherwise(docker)
    return read(spark, d, "documents").select("doc_id", failures.engine_info(info).alias("e")).select("doc_id", "e.*")


@query("""select doc_id, case when policy = 'never' and asked = 'gpu' then null when policy = 'required' and (asked = 'cpu' or not gpu) then null when asked = 'gpu' and not gpu then null when policy = 'required' then 'gpu' when policy = 'never' then 'cpu' else coalesce(asked, case when gpu then 'gpu' else 'cpu' end) end as device
from (select doc_id, case doc_id % 3 when 0 then 'never' when 1 then 'optional' else 'required' end as policy, doc_id % 2 = 0 as gpu, case doc_id % 5 when 0 then 'cpu' when 1 then 'gpu' end as asked from documents)""")
def device_choice(spark, d):
    n = F.col("doc_id")
    asked = read(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, "never").when(n % 3 == 1, "optional").otherwise("required").alias("policy"), (n % 2 == 0).alias("gpu_available"), F.when(n % 5 == 0, "cpu").when(n % 5 == 1, "gpu").alias("asked"))
    return failures.choose_device(asked).select("doc_id", "device")


@query("select doc_id, text[:1000] as text, length(text) > 1000 as truncated from documents")
def bounded_output(spark, d):
    return read(spark, d, "documents").select("doc_id", failures.bounded_capture(F.col("text"), 1000).alias("c")).select("doc_id", "c.*")


# Appends, resolution, record checks.


@query("""select run_id::varchar as run_id, case when run_id % 9 = 0 then 'no artifacts' when run_id % 10 < 3 then 'run has a record' when run_id % 4 <> 3 and not exists (select 1 from v_snapshots s where s.digest = source_hash and s.kind = 'file') then 'snapshot not archived' else 'source without snapshot' end as problem from v_runs
where run_id % 9 = 0 or run_id % 10 < 3 or (run_id % 4 <> 3 and not exists (select 1 from v_snapshots s where s.digest = source_hash and s.kind = 'file')) or (run_id % 4 = 3 and run_id % 8 = 3)""")
def creation_problems(spark, d):
    runs = view(spark, d, "v_runs").withColumn("n", F.col("run_id"))
    has = F.col("n") % 4 != 3
    asked = runs.select(F.col("n").cast("string").alias("run_id"), F.when(F.col("n") % 9 == 0, 0).otherwise(1).alias("artifacts"), F.when(has, F.col("source_hash")).alias("source_hash"), F.when(has, F.lit("file")).alias("source_kind"), F.when(F.col("n") % 8 == 3, F.lit("s")).alias("source_id"))
    return commits.creation_problems(asked, runs.where("n % 10 < 3").select(F.col("n").cast("string").alias("run_id")), view(spark, d, "v_snapshots"))


@query("""with l as (select record_id, arg_max(state, doc_id) as o from (select doc_id, 'rec-' || (doc_id % 50) as record_id, case when doc_id % 3 = 0 then 'diverged' else 'reproduced' end as state from v_replays) group by 1) select record_id from l where o = 'diverged'""")
def diverged_records(spark, d):
    replays = view(spark, d, "v_replays").select(F.concat(F.lit("rec-"), (F.col("doc_id") % 50).cast("string")).alias("record_id"), F.format_string("%012d", F.col("doc_id")).alias("replayed_at"), "replay_id", F.when(F.col("doc_id") % 3 == 0, "diverged").otherwise("reproduced").alias("outcome"))
    return commits.diverged(replays)


@query(f"""with {_VALIDATION}, r as (select record_id, max(case status when 'missing' then 3 when 'drift' then 2 else 0 end) as s from v group by 1)
select record_id, case s when 3 then 'artifact_missing' else 'artifact_drift' end as reason from r where s > 0""")
def drifted_records(spark, d):
    return commits.drifted(ledger.validation_plan(validation_files(spark, d)))


@query("""select distinct w.record_id, 'index' as target_kind, 't' || (doc_id % 2) as target from v_records w where doc_id % 2 = 1 or doc_id % 3 = 0""")
def open_deliveries(spark, d):
    target = F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"))
    wanted = view(spark, d, "v_records").select("doc_id", "record_id", F.lit("index").alias("target_kind"), target.alias("target"))
    return commits.open_deliveries(wanted.drop("doc_id").unionByName(wanted.drop("doc_id")), wanted.where("doc_id % 2 = 0 and doc_id % 3 <> 0").drop("doc_id"))


@query(f"""with s as (select digest, bool_and(sha256(content) = digest) as ok from v_blobs group by digest), b as (select record_id, bool_and(coalesce(ok, false)) as whole from v_manifest left join s using (digest) group by 1),
t as (select v.dispatch_id, {_MAPPED.format('e')} as status from v_deliveries v left join (select dispatch_id, arg_max(event, event_id) as e from v_delivery_events group by 1) using (dispatch_id))
select v.dispatch_id, case when r.state <> 'sealed' then 'not sealed' when not whole then 'bundle broken' when status = 'delivered' then 'already delivered' else 'ready' end as verdict from v_deliveries v join v_records r using (record_id) join b using (record_id) join t using (dispatch_id)""")
def dispatchable(spark, d):
    return commits.dispatchable(view(spark, d, "v_records"), bundle_verify(spark, d), view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events"))


@query("""with v as (select *, doc_id::bigint as n from documents), s as (select n, 'dlv-' || n as dispatch_id, n % 3 = 0 as bad, n % 7 <> 0 as sent, case when n % 5 = 0 then 'refused' end as error, n % 11 = 0 as gone from v where n % 2 = 0)
select dispatch_id, 1 as step, 'failure' as event, 'empty content' as detail, 'now' as "at" from s where bad union all select dispatch_id, 2, 'intent', 'd' || n, 'now' from s where not bad union all select dispatch_id, 3, 'receipt', null, 'now' from s where not bad and sent and error is null
union all select dispatch_id, 4, 'failure', error, 'now' from s where not bad and sent and error is not null union all select dispatch_id, 5, 'removal_intent', null, 'now' from s where not bad and sent and error is null and gone""")
def dispatch_log(spark, d):
    """What dispatching half of the deliveries writes: payloads that break a rule, targets that refuse or don't answer, records
    invalidated meanwhile."""
    n = F.col("n")
    own = read(spark, d, "documents").select(F.col("doc_id").alias("n"), F.concat(F.lit("dlv-"), F.col("doc_id").cast("string")).alias("dispatch_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"))
    verdicts = own.select("dispatch_id", "record_id", F.when(n % 2 == 0, "ready").otherwise("not sealed").alias("verdict"))
    violations = own.where(n % 3 == 0).select("record_id", F.lit("empty content").alias("violation"))
    payloads = own.select("record_id", F.concat(F.lit("d"), n.cast("string")).alias("digest"))
    written = own.where(n % 7 != 0).select("dispatch_id", F.when(n % 5 == 0, "refused").alias("error"))
    states = own.select("record_id", F.when(n % 11 == 0, "invalidated").otherwise("sealed").alias("state"))
    return commits.dispatch_events(verdicts, violations, payloads, written, states, F.lit("now"))


@query("""select 'dlv-' || doc_id as dispatch_id, case when doc_id % 4 = 0 then 'removal_failure' else 'removal_receipt' end as event, case when doc_id % 4 = 0 then 'busy' end as detail from documents where doc_id % 3 <> 0""")
def removal_log(spark, d):
    own = read(spark, d, "documents").select("doc_id", F.concat(F.lit("dlv-"), F.col("doc_id").cast("string")).alias("dispatch_id"))
    answers = own.where("doc_id % 3 <> 0").select("dispatch_id", F.when(F.col("doc_id") % 4 == 0, "busy").alias("error"))
    return commits.removal_events(own.unionByName(own), answers, F.lit("now")).drop("at")


@query("""select user_id, 'index:{"collection":' || to_json(event_type) || ',"host":null,"name":"' || user_id || '"}' as target from events""")
def target_encoding(spark, d):
    fields = {"name": F.col("user_id").cast("string"), "collection": F.col("event_type"), "host": F.lit(None).cast("string")}
    return read(spark, d, "events").select("user_id", commits.encode_target(F.lit("index"), fields).alias("target"))


@query("""select run_id, case when memory_limit <> '' and regexp_full_match(memory_limit, '(\\d+(\\.\\d+)?) ?[kKmMgGtTpP]?[iI]?[bB]?') and try_cast(regexp_extract(memory_limit, '^[0-9.]+') as double) > 0 then '{"cpus":2.0,"memory":' || to_json(memory_limit) || '}' end as conditions from v_runs""")
def conditions_form(spark, d):
    stated = F.concat(F.lit('{ "memory": '), canon.quote_json(F.col("memory_limit")), F.lit(', "cpus": 2.0 }'))
    return view(spark, d, "v_runs").select("run_id", ledger.canonical_conditions(stated).alias("conditions"))


@query("""select v.dispatch_id, count(event_id) as n, coalesce(string_agg(event, ',' order by event_id), '') as log from v_deliveries v left join v_delivery_events using (dispatch_id) group by 1""")
def delivery_history(spark, d):
    logs = commits.history(view(spark, d, "v_deliveries"), view(spark, d, "v_delivery_events"))
    return logs.select("dispatch_id", F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("events", lambda e: e["event"]), ","), F.lit("")).alias("log"))


@query(f"""with s as (select digest, bool_and(sha256(content) = digest) as ok from v_blobs group by digest), b as (select record_id, bool_and(coalesce(ok, false)) as whole from v_manifest left join s using (digest) group by 1),
{_REFS}, p as (select ref, case type when 'source' then (case when doc_id % 3 <> 0 and false then null when not exists (select 1 from v_snapshots s where s.digest = f.digest) then 'no source' end)
  when 'snapshot' then (case when not exists (select 1 from v_snapshots s where s.digest = f.digest and s.kind = 'file') then 'no snapshot' end)
  when 'event' then (case when doc_id % 5 = 0 then 'no event' when doc_id % 7 = 0 then 'other event' end)
  else (select case when r.state <> 'sealed' then 'record is ' || r.state when not b.whole then 'output does not verify' end from v_records r join b using (record_id) where r.record_id = f.id) end as problem from f)
select ref, problem from p""")
def ref_resolve(spark, d):
    records = view(spark, d, "v_records").withColumn("observation_digest", F.lit(None).cast("string"))
    snapshots = view(spark, d, "v_snapshots")
    log = records.where("doc_id % 5 <> 0").select((F.col("doc_id") + 1).alias("seq"), F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("source_hash")).alias("hash"))
    return resolution.resolve(_refs(spark, d).select("ref"), snapshots.select(F.col("digest").alias("source_id")), snapshots.withColumn("ok", F.lit(True)), records, bundle_verify(spark, d), log, True)


@query("""select record_id, unnest(['provenir:record:' || record_id || '@' || artifact_hash, 'provenir:observation:' || record_id || '@' || sha256('{"observed_at":"' || created_at || '","record_id":"' || record_id || '","schema":"provenir.observation","schema_version":1,"snapshot":{"digest":"' || source_hash || '","kind":"file"},"source_id":null}'),
  'provenir:snapshot:file:' || source_hash, 'provenir:event:' || (doc_id + 1) || '@' || artifact_hash]) as ref from v_records""")
def record_refs(spark, d):
    records = view(spark, d, "v_records")
    events = records.select(F.col("record_id").alias("subject"), (F.col("doc_id") + 1).alias("seq"), F.col("artifact_hash").alias("hash"))
    return resolution.of_record(records, events)


@query("""with j as (select *, row_number() over (partition by record_id order by doc_id, lane_order) as nth from v_journal where status = 'sealed'),
c as (select j.*, case when doc_id % 12 = 5 then 'pending' else 'sealed' end as rs, doc_id % 14 = 3 as other, doc_id % 16 = 7 as parser, case when doc_id % 18 = 9 then 'missing' else 'ok' end as v from j)
select path, lane, unnest(case when doc_id % 22 = 1 then ['not in the ledger'] else list_filter([case when rs <> 'sealed' then 'not sealed' end, case when other then 'another run' end, case when parser then 'another parser' end, case when lane <> 'base' then 'another backend' end, case when nth > 1 then 'claimed twice' end, case when doc_id % 26 = 11 then 'another input' end, case when v <> 'ok' then 'does not verify' end], lambda x: x is not null) end) as problem from c""")
def record_problems(spark, d):
    n = F.col("doc_id")
    seen = view(spark, d, "v_journal").where("status = 'sealed'").withColumn("run_id", F.col("record_id")).withColumn("artifact_hash", F.col("record_id"))
    rows = seen.select("doc_id", "record_id", "path").dropDuplicates(["record_id"])
    records = rows.where(n % 22 != 1).select("record_id", F.when(n % 14 == 3, F.lit("x")).otherwise(F.col("record_id")).alias("run_id"), F.when(n % 12 == 5, "pending").otherwise("sealed").alias("state"), F.col("record_id").alias("artifact_hash"), F.when(n % 16 == 7, "other").otherwise("mineru").alias("parser_name"), F.lit("1").alias("parser_version"), F.lit("oci").alias("backend"), F.col("path").alias("source_hash"))
    corpus = view(spark, d, "v_doc_corpus").withColumn("sha256", F.when(F.substring("path", 5, 8).cast("long") % 26 == 11, F.lit("x")).otherwise(F.col("path")))
    valid = rows.select("record_id", F.when(n % 18 == 9, "missing").otherwise("ok").alias("status"))
    return resolution.record_problems(seen, records, corpus, valid, {"base": "oci", "cand_a": "wasm", "cand_b": "wasm"}, ("mineru", "1"))


@query(_MD_UNITS + """ select 'rec-' || printf('%08d', doc_id) || ':' || unit_id as chunk_id, sha256(text) as content_hash from u where doc_id % 19 <> 0 and doc_id % 23 <> 0 and not (doc_id % 17 = 0 and i = 1) and (select text from documents d where d.doc_id = u.doc_id) in (select text from documents where doc_id % 29 <> 0)""")
def extraction_chunks(spark, d):
    """Units that resolve, as chunks."""
    anchors, manifest, blobs = _anchored(spark, d)
    good = markdown.resolve(anchors, manifest, blobs).where("problem is null").withColumn("artifact_hash", F.col("digest"))
    return markdown.chunks(good).select("chunk_id", "content_hash")


@query(_TREE + """, f as (select t.*, (row_number() over (partition by conv_id order by path) - 1)::bigint as ord from t), u as (select *, 'u' || printf('%06d', row_number() over (partition by conv_id order by ord)) as unit_id from f where text <> '')
select u.conv_id, u.unit_id, '/mapping/' || u.node_id || '/message' as pointer, a.unit_id as parent, '{"node_id":"' || u.node_id || '"' || case when v.role <> 'user' then ',"role":"' || v.role || '"' else '' end || ',"depth":' || u.depth || '}' as attributes
from u left join u a on a.conv_id = u.conv_id and a.node_id = u.above join v_conv_nodes v on v.conv_id = u.conv_id and v.node_id = u.node_id""")
def message_units(spark, d):
    nodes = _listed(spark, d)
    roles = nodes.select("conv_id", "node_id", F.when(F.col("role") != "user", F.col("role")).alias("role"))
    flat = conversations.flatten(nodes).join(roles, ["conv_id", "node_id"]).select(F.col("conv_id").alias("record_id"), "node_id", "ord", "text", "parent_node_id", "role", "depth")
    return markdown.conversation_units(flat).select(F.col("record_id").alias("conv_id"), "unit_id", "pointer", "parent", "attributes")


@query("select doc_id, case doc_id % 5 when 0 then 'form' when 1 then 'fields' when 2 then 'schema' when 3 then 'not an object' end as problem from documents")
def strict_records(spark, d):
    """Records of which some are not canonical, and what is wrong with them."""
    record = canon.snapshot_record(F.lit("file"), canon.sha256(F.col("text")), F.octet_length("text"), F.lit(1))
    spoiled = F.when(F.col("doc_id") % 5 == 0, F.replace(record, F.lit(":1,"), F.lit(": 1,"))).when(F.col("doc_id") % 5 == 1, F.replace(record, F.lit("file_count"), F.lit("files"))).when(F.col("doc_id") % 5 == 2, F.replace(record, F.lit(".snapshot"), F.lit(".source"))).when(F.col("doc_id") % 5 == 3, F.substring(record, 1, 40)).otherwise(record)
    return read(spark, d, "documents").select("doc_id", canon.strict_problem(spoiled, "provenir.snapshot", ("kind", "digest", "size", "file_count")).alias("problem"))
