"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import bpe, importance, linededup, matroska, mixing, quality, secrets, simhash, toxicity, warc
from provenir.llm.common import prepare


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a source, documents of 1,000 characters or more are twice as likely as shorter ones, of 5,000 four times."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    docs = _read(spark, sf_dir, "documents").withColumn("weight", F.when(chars < 1000, 1.0).when(chars < 5000, 2.0).otherwise(4.0))
    mixed = mixing.pareto_mix(docs, importance="weight")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), matroska.media(F.col("text")).alias("media"))
    back = stored.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), matroska.features(F.col("media")).alias("f"))
    return back.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "media_bytes", "media_sha256", "f.feature")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; the share of documents that is kept is that of good ones in the labels."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    sampled = importance.importance_resample(docs, importance.labelled_target(docs, labels), 1.0 if share is None else share, carry=["doc_id"])
    return sampled.select("doc_id", "log_weight", "gumbel_key", "kept")


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: of the documents up to the median doc_id, then of all, where only unseen blobs are read."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    _, ledger = secrets.secret_scan(docs.where(F.coalesce(F.col("doc_id") <= half, F.lit(False))))
    found, _ = secrets.secret_scan(docs, ledger)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secrets.RULES]))
    spans = found.select("doc_id", *[count(r.kind) for r in secrets.RULES], secrets.as_text(base).alias("base"), secrets.as_text(F.col("findings")).alias("spans"))
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.quality_rules(_read(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def encoder(spark: SparkSession, path: str | None = None) -> bpe.ByteBpe:
    """The byte-level BPE of a public vocabulary; another file's path may be given."""
    import public_tokenizers

    return bpe.ByteBpe(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, coder = _read(spark, sf_dir, "documents"), encoder(spark)
    ids = docs.select("doc_id", coder.encode(F.col("text")).alias("ids"))
    both = ids.select("doc_id", "ids", coder.decode(F.col("ids")).alias("decoded"))
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_simhash_components": op2_simhash_components,
    "op3_matroska_columns": op3_matroska_columns,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_warc_normaliser": op6_warc_normaliser,
    "op7_blob_ledger_secrets": op7_blob_ledger_secrets,
    "op8_line_frequency_rules": op8_line_frequency_rules,
    "op9_rank_queue_bpe": op9_rank_queue_bpe,
    "op10_line_windows": op10_line_windows,
}

ORACLE_SQL: dict[str, str] = {}

#: Targets by water-filling over sources, rates by water-filling over weights, then the Pareto rank of each row and the words
#: before it in its source.
ORACLE_SQL["op1_pareto_mix"] = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as w,
    case when coalesce(length(text), 0) < 1000 then 1.0 when length(text) < 5000 then 2.0 else 4.0 end::double as v,
    md5('1:1|' || coalesce(length(doc_id::varchar) || ':' || doc_id::varchar, '-') || '|' || coalesce(length(text) || ':' || text, '-')) as tie
  from documents),
s as (select source, sum(w)::bigint as size from d group by source),
o as (select *, row_number() over (order by encode(source) nulls last) as rn, (3 * size)::double as cap from s),
w as (select *, ((rn - 1) % 3 + 1)::double as weight from o),
l as (select *, (sum(size) over ())::double as total,
    ((sum(size) over ())::double - coalesce(sum(cap) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
  from w window f as (order by cap / weight, rn rows between unbounded preceding and 1 preceding)),
c as (select *, cap <= level * weight as capped from l),
t as (select source, size, case when capped then cap else weight *
    ((total - coalesce(sum(case when capped then cap end) over (), 0)) / sum(case when not capped then weight end) over ()) end as target from c),
k as (select source, v, sum(w)::double as words from d group by source, v),
j as (select k.*, size, target, (target - 3 * coalesce(sum(words) over f, 0)) /
    nullif(sum(words * v) over (partition by k.source) - coalesce(sum(words * v) over f, 0), 0) * v >= 3 as filled
  from k join t on k.source is not distinct from t.source window f as (partition by k.source order by v desc rows between unbounded preceding and 1 preceding)),
r0 as (select source, size, target, (target - 3 * coalesce(sum(words) filter (coalesce(filled, false)), 0)) /
    nullif(sum(words * v) filter (not coalesce(filled, false)), 0) as rate from j group by source, size, target),
e as (select d.*, size, target, case when size > 0 then least(3.0::double, coalesce(rate * v, 3.0::double)) else 0 end as e,
    (('0x' || substr(tie, 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from d join r0 on d.source is not distinct from r0.source),
p as (select *, floor(e)::bigint as certain, e - floor(e) as p from e),
q as (select *, case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as q from p),
x as (select *, q / (1 + q) as x, target - sum(certain * w) over (partition by source) as goal from q),
r as (select *, sum(case when p > 0 then w end) over (partition by source order by x, tie range unbounded preceding) as after,
    sum(w) over (partition by source, x, tie) as unit from x)
select doc_id, w as size, size::bigint as source_size, target,
  ((certain + case when p > 0 and 2 * goal > 2 * after - unit then 1 else 0 end) * w)::bigint as taken from r
"""

#: Matches by regexp_extract_all; their places from the lengths of the pieces between them.
ORACLE_SQL["op7_blob_ledger_secrets"] = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
m as (select row, kind, ord, least, w, g, s, unnest(range(1, len(w) + 1)) as i from (
  select row, 'assign' as kind, 0 as ord, 6 as least,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as w,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as g,
    string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as s from d
  union all
  select row, 'access', 1, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
  union all
  select row, 'hex', 2, 24, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') from d)),
p as (select row, kind, ord, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) as a,
    length(w[i]) as n from m where length(g[i]) >= least),
a as (select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, ord) as spans from p group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (row)
"""

ORACLE_SQL["op8_line_frequency_rules"] = r"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
g as (select row, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8),
h as (select row, i, array_to_string(w[i:i+7], ' ') as k from g),
r as (select row, i from h qualify count(*) over (partition by row, k) > 1),
c as (select row, sum(least(8, coalesce(nxt - i, 8))) as n from (select row, i, lead(i) over (partition by row order by i) as nxt from r) group by row),
lines as (select row, unnest(l) as x, source, t from d),
n as (select row, source, t, x, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as k,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as words from lines where regexp_matches(x, '[^\x20\x09-\x0D]')),
u as (select row, count(*) - count(distinct x) as dups from n group by row),
f as (select n.source, k from n join (select source, count(distinct t) as docs from d group by source) s on n.source is not distinct from s.source
  group by n.source, k, docs having count(distinct t) > 20 and count(distinct t) > docs * 0.005::double),
z as (select row, sum(words) as removed from n join f on n.source is not distinct from f.source and n.k = f.k group by row),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dups, 0)::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, coalesce(removed, 0)::bigint as removed_words
  from d left join c using (row) left join u using (row) left join z using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (removed_words > 0 and
    (n_words - removed_words < 10 or n_words - removed_words < 0.3::double * n_words)) as kept
from b
"""

#: Base32 from the bits of the SHA-1, five at a time.
ORACLE_SQL["op6_warc_normaliser"] = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
b as (select page_id, h, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(('0x' || c)::int), 4, '0')), '') as bits, max(page_id) over (partition by h) as holder from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * k + j, 1)::bigint << (5 - j)))::bigint, 1)), '') as payload_digest,
  case when page_id = holder then 'response' else 'revisit' end as record_type, case when page_id <> holder then holder end as refers_to
from b
"""
