"""Views over the given tables that give each operator its input, in Spark and, by the same text, in DuckDB.

{documents} and the like stand for tables; H<x> for the SHA-256 of a text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "events", "pages", "labels", "embeddings", "benchmark", "lineitem", "orders", "customer", "part", "supplier", "nation", "region")

_RECORDS = """
select doc_id, concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id,
  concat('run-', lpad(cast(doc_id as string), 8, '0')) as run_id,
  H<text> as source_hash, 'file' as source_kind,
  case doc_id % 4 when 0 then 'mineru' when 1 then 'marker' when 2 then 'docling' else 'probe' end as parser_name,
  case when doc_id % 8 < 4 then '1.0' else '1.1' end as parser_version,
  case when doc_id % 2 = 0 then 'bubblewrap' else 'oci-runc' end as backend,
  case when doc_id % 5 = 0 then null when doc_id % 3 = 0 then '{{"cpus":2.0,"device":"gpu"}}' else '{{"cpus":2.0,"device":"cpu"}}' end as run_conditions,
  case when doc_id % 10 < 7 then 'sealed' when doc_id % 10 = 7 then 'pending' when doc_id % 10 = 8 then 'failed' else 'invalidated' end as state,
  H<concat(text, '|out')> as artifact_hash,
  concat('2024-01-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), 'T00:00:00+00:00') as created_at
from {documents}"""

_MANIFEST = """
select concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id, 'document.md' as path, H<text> as digest from {documents}
union all
select concat('rec-', lpad(cast(doc_id as string), 8, '0')), 'parser.json', H<concat('{{"lang":"', lang, '"}}')> from {documents}"""

VIEWS: dict[str, str] = {
    "v_records": _RECORDS,
    "v_manifest": _MANIFEST,
    # What is stored: every tenth text is missing, every thirteenth was altered.
    "v_blobs": """
select distinct digest, content, size from (
  select H<text> as digest, case when doc_id % 13 = 0 then concat(text, '!') else text end as content, cast(octet_length(encode(text, 'utf-8')) as bigint) as size
  from {documents} where doc_id % 10 <> 0
  union all
  select H<concat('{{"lang":"', lang, '"}}')>, concat('{{"lang":"', lang, '"}}'), cast(octet_length(encode(concat('{{"lang":"', lang, '"}}'), 'utf-8')) as bigint) from {documents})""",
    # What is on disk: some files gone, some changed, some unsafe.
    "v_disk": """
select record_id, path, case when doc_id % 7 = 0 and path = 'document.md' then H<concat(text, '?')> else digest end as digest, doc_id % 19 <> 0 as safe from (
  select doc_id, text, concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id, 'document.md' as path, H<text> as digest from {documents} where doc_id % 11 <> 0
  union all
  select doc_id, text, concat('rec-', lpad(cast(doc_id as string), 8, '0')), 'parser.json', H<concat('{{"lang":"', lang, '"}}')> from {documents})""",
    "v_delivery_events": """
select event_id, concat('dlv-', cast(user_id as string)) as dispatch_id,
  case event_type when 'click' then 'intent' when 'purchase' then 'receipt' when 'error' then 'failure' when 'view' then 'removal_intent' else (case when event_id % 3 = 0 then 'removal_receipt' else 'removal_failure' end) end as event,
  case when event_type in ('view','signup') or event_id % 4 = 0 then null else concat('a', cast(event_id % 3 as string)) end as attempt_id,
  case when event_type = 'purchase' then 5 when event_type = 'error' then (case event_id % 3 when 0 then 0 when 1 then 2 else null end) else null end as done,
  cast(5 as int) as planned, H<concat('payload-', cast(case when event_id % 17 = 0 then event_id % 3 else 0 end as string))> as chunks_digest,
  case when event_type in ('error', 'signup') then concat('error ', cast(event_id % 5 as string)) else null end as error
from {events}""",
    "v_deliveries": """
select concat('dlv-', cast(doc_id as string)) as dispatch_id, concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id, 'index' as target_kind,
  concat('2024-02-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), 'T00:00:00+00:00') as created_at from {documents}""",
    "v_conv_nodes": """
select cast(conv_id as string) as conv_id, turn as ord, concat('n', cast(turn as string)) as node_id,
  case when turn = 0 then null when turn % 3 = 2 then concat('n', cast(turn - 2 as string)) else concat('n', cast(turn - 1 as string)) end as parent,
  role, case when role = 'system' then '' else text end as text
from {conversations}""",
    "v_corpus": "select concat('pages/', lpad(cast(page_id as string), 8, '0'), '.html') as path, H<html> as digest, page_id, length(html) as n_chars from {pages}",
    "v_present": """
select concat('pages/', lpad(cast(page_id as string), 8, '0'), case when page_id % 37 = 0 then '.new' else '.html' end) as path,
  case when page_id % 23 = 0 then H<concat(html, '!')> else H<html> end as digest from {pages} where page_id % 29 <> 0""",
    "v_journal": """
select d.doc_id, l.lane, l.lane_order, concat('doc/', lpad(cast(d.doc_id as string), 8, '0'), '.md') as path, cast(d.doc_id * 8 + l.lane_order as bigint) as line,
  case when (d.doc_id + l.lane_order * 7) % 11 = 0 then 'failed' when (d.doc_id + l.lane_order) % 29 = 0 then 'error' when d.doc_id % 23 = 0 then 'not_applicable' else 'sealed' end as status,
  case when (d.doc_id + l.lane_order * 7) % 11 = 0 then (case when d.doc_id % 2 = 0 then 'timeout' else 'exit_status' end) else null end as reason,
  case when (d.doc_id + l.lane_order) % 13 = 0 and l.lane_order > 0 then H<concat(d.text, l.lane)> else H<d.text> end as artifact_hash,
  case when d.doc_id % 9 = 0 then concat('rec-', cast(d.doc_id as string)) else concat('rec-', cast(d.doc_id as string), l.lane) end as record_id,
  case when d.doc_id % 17 = 0 then null else cast(d.n_chars * (10 + l.lane_order) as double) / 1000.0 end as wall_time_seconds
from {documents} d cross join (select 'base' as lane, 0 as lane_order union all select 'cand_a', 1 union all select 'cand_b', 2) l
where (d.doc_id * 3 + l.lane_order) % 41 <> 0""",
    "v_doc_corpus": "select concat('doc/', lpad(cast(doc_id as string), 8, '0'), '.md') as path from {documents}",
    "v_waivers": """
select concat('doc/', lpad(cast(doc_id as string), 8, '0'), '.md') as path, case when doc_id % 2 = 0 then 'cand_a' else 'cand_b' end as lane,
  case doc_id % 3 when 0 then 'diverged' when 1 then 'regression' else 'failure_mismatch' end as outcome, case when doc_id % 5 = 0 then ' ' else 'known' end as reason
from {documents} where doc_id % 4 = 1""",
    "v_runs": """
select doc_id as run_id, case doc_id % 4 when 0 then 'bubblewrap' when 1 then 'oci-runc' when 2 then 'wasmtime' else 'other' end as backend,
  cast(case doc_id % 9 when 0 then 0 when 1 then 159 when 2 then 137 when 3 then 126 when 4 then -9 when 5 then 1 when 6 then 139 else 0 end as int) as exit_code,
  doc_id % 31 = 0 as timed_out, cast(doc_id % 300 as double) as seconds, cast(150 as double) as timeout_seconds, doc_id % 8 < 6 as syscall_filter,
  case when doc_id % 4 = 2 then (case doc_id % 7 when 0 then 'interrupt' when 1 then 'fuel' when 2 then 'link' when 3 then 'unreachable' else null end) else null end as trap,
  cast(doc_id % 3 as bigint) as memory, cast(2 as bigint) as memory_cap,
  concat('{{"cpus":2.0,"memory":"', case when doc_id % 6 = 0 then '0g' else '4g' end, '","pids_limit":512}}') as stated,
  case when doc_id % 5 = 0 then '{{"cpus":2,"memory":"4g"}}' when doc_id % 5 = 1 then '{{"cpus":4,"memory":"4g","pids_limit":512}}' else '{{"cpus":2,"memory":"4g","pids_limit":512}}' end as applied,
  case when doc_id % 12 = 0 then '' else case doc_id % 5 when 0 then '512m' when 1 then '1.5 GiB' when 2 then '0' when 3 then 'lots' else '2048' end end as memory_limit,
  case doc_id % 3 when 0 then 'committed' when 1 then 'pending' else 'failed' end as old_state, doc_id % 4 <> 0 as bundle_ok, H<text> as source_hash
from {documents}""",
    "v_snapshots": """
select H<text> as digest, 'file' as kind from {documents} where doc_id % 3 <> 0
union all select H<text>, 'tree' from {documents} where doc_id % 7 = 0""",
    # Each record: created, then what its number says, some of it not allowed.
    "v_record_events": """
select cast(doc_id * 4 + 1 as bigint) as seq, concat('rec-', cast(doc_id as string)) as subject, 'record.created' as kind, '{{}}' as body from {documents} where doc_id % 50 <> 0
union all select doc_id * 4 + 2, concat('rec-', cast(doc_id as string)), case when doc_id % 5 = 0 then 'record.failed' else 'record.sealed' end, '{{}}' from {documents} where doc_id % 6 <> 0
union all select doc_id * 4 + 3, concat('rec-', cast(doc_id as string)), case when doc_id % 4 = 0 then 'record.sealed' else 'record.invalidated' end, '{{}}' from {documents} where doc_id % 3 = 0""",
    "v_states": """
select concat('rec-', cast(doc_id as string)) as record_id, case when doc_id % 10 < 7 then 'sealed' else 'pending' end as state from {documents} where doc_id % 70 <> 1""",
    "v_events_log": """
select cast(user_id as string) as chain, event_id as ord, event_type as kind, cast(user_id as string) as subject, props as body, TS<ts> as `at` from {events}""",
    "v_chunks": """
select concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id, cast(k as int) as ord, case when doc_id % 41 = 0 then 'c0' when doc_id % 43 = 0 and k = 1 then '' else concat('c', cast(k as string)) end as chunk_id,
  case when doc_id % 47 = 0 and k = 1 then '' else concat(text, ' ', cast(k as string)) end as content,
  case when doc_id % 53 = 0 then H<text> else H<concat(text, ' ', cast(k as string))> end as content_hash,
  cast(case when doc_id % 59 = 0 then -1 else k end as bigint) as token_count, case when doc_id % 61 = 0 then '{{' else '{{"k":1}}' end as metadata
from {documents} cross join (select 0 as k union all select 1) where doc_id % 67 <> 0""",
    "v_signoffs": """
select cast(doc_id % 10 as string) as signoff_id, concat('rec-', lpad(cast(doc_id as string), 8, '0')) as record_id,
  case when doc_id % 33 = 0 then H<text> else H<concat(text, '|out')> end as artifact_hash from {documents} where doc_id % 3 = 0
union all select '0', concat('gone-', cast(doc_id as string)), H<text> from {documents} where doc_id % 100 = 3""",
    "v_replays": """
select doc_id, concat('rpl-', cast(doc_id as string)) as replay_id, case when doc_id % 10 < 8 then 'sealed' when doc_id % 10 = 8 then 'invalidated' else 'pending' end as state,
  case when doc_id % 37 = 0 then null else 'mineru' end as parser_name, doc_id % 31 <> 0 as in_catalog, doc_id % 29 <> 0 as conditions_ok, doc_id % 2 = 0 as deterministic, doc_id % 3 = 0 as has_policy,
  doc_id % 23 <> 0 as module_ok, doc_id % 19 <> 0 as input_ok, true as config_ok, doc_id % 17 <> 0 as backend_ok, doc_id % 13 <> 0 as measured_ok, doc_id % 11 <> 0 as succeeded,
  cast(case when doc_id % 7 < 4 then 0 else doc_id % 7 end as int) as differences, doc_id % 5 <> 0 as policy_accepts from {documents}""",
}


def _text(name: str, digest: str, stamp: str, at: str) -> str:
    text = re.sub(r"H<(.*?)>(?=[ ,)\n]|$)", lambda m: digest.format(m[1]), VIEWS[name])
    return re.sub(r"TS<(.*?)>", lambda m: stamp.format(m[1]), text).replace("`at`", at)


def _duck(name: str) -> str:
    text = _text(name, "sha256({})", "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')", '"at"')
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace("{{", "{").replace("}}", "}").replace(", 'utf-8')", ")")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables that it names are read."""
    text = _text(name, "sha2({}, 256)", "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "`at`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} as ({_duck(n)})" for n in names)
    if not names:
        return sql
    rest = sql.strip()
    if rest.lower().startswith("with recursive"):
        return f"with recursive {head}, {rest[14:]}"
    return f"with {head}, {rest[4:]}" if rest.lower().startswith("with ") else f"with {head} {rest}"
