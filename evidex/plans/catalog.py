"""Queries of the reference's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions.times import epoch_us
from evidex.operators import claims as C
from evidex.operators import evaluate as E
from evidex.operators import graph as G
from evidex.operators import relational as R
from evidex.operators import retrieval as S
from evidex.operators import review as V
from evidex.operators import segments as SG
from evidex.session import load, stage

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """One message per conversation and number: the last delivered."""
    m = load(spark, d, "messages").where("conversation_id is not null and sequence_index is not null")
    return R.latest_by_max(m, ["conversation_id", "sequence_index"], ["imported_at", "id"])


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered message with estimated tokens in place of texts, which are measured before they would be shuffled."""
    m = load(spark, d, "messages").where("conversation_id is not null and sequence_index is not null")
    return m.select("id", "conversation_id", "sequence_index", "imported_at", "role", T.token_estimate(F.col("content_text")).alias("tokens"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """_ordered() of _measured()."""
    return R.latest_by_max(_measured(spark, d), ["conversation_id", "sequence_index"], ["imported_at", "id"])


_ORDERED_SQL = """(select * from messages where conversation_id is not null and sequence_index is not null
  qualify row_number() over (partition by conversation_id, sequence_index order by imported_at desc, id desc) = 1)"""



def _greedy_sql(items: str, target: int, out: str, tail: str = "") -> str:
    """SQL of the greedy fold over items (k, pos, size), one recursion step per item."""
    new = f"r.full or r.open + m.size > {target}"
    return f"""
with recursive m as (select k, pos, size, row_number() over (partition by k order by pos) as n from ({items})),
r as (select k, pos, n, size as open, 0 as segment, size > {target} as full from m where n = 1
  union all select m.k, m.pos, m.n, case when {new} then m.size else r.open + m.size end, r.segment + case when {new} then 1 else 0 end, m.size > {target} and ({new})
  from r join m on m.k = r.k and m.n = r.n + 1)
select {out} from r {tail}"""


_TOKENS_SQL = "case when coalesce(length(content_text), 0) = 0 then 0 else greatest(1, cast(ceil(length(content_text) / 2.5) as integer)) end"
_UNITS_SQL = f"""select conversation_id as k, sequence_index as q, {_TOKENS_SQL} as size, case when lower(coalesce(role, '')) = 'assistant' and lag(lower(coalesce(role, ''))) over w = 'user'
  then lag(sequence_index) over w else sequence_index end as unit from {_ORDERED_SQL} window w as (partition by conversation_id order by sequence_index)"""
_PROMPT_SQL = "case when lower(coalesce(role, '')) = 'tool' then 60 else coalesce(length(content_text), 0) end + length(id) + coalesce(length(role), 0) + 80"
_VOCABULARY_SQL = "(values " + ", ".join(f"('{p}', '{st}', '{k}', '{r}')" for p, st, _, k, _, r in C.VOCABULARY) + ") v(predicate, stability, kind, required)"

_KEYS_SQL = "subject_normalized, predicate, group_object_key"
_US_SQL = r"""coalesce(case when regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$') then epoch_us(try_cast(created_at as timestamptz)) end,
  case when regexp_matches(created_at, '^\d{9,10}(\.\d{1,6})?$') then cast(cast(created_at as decimal(20, 6)) * 1000000 as bigint) end, epoch_us(imported_at))"""
_SUBJECT_SQL = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '[.,;:!?]+$', '')"
_ACTIVE_CLAIMS_SQL = """(select * from claims where conversation_id is not null and segment_id in (
  select id from segments where is_active and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null))"""
_CONSOLIDATED_SQL = f"""
v as (select * from (values {", ".join(f"('{p}', '{c}', '{k}', '{g}')" for p, _, c, k, g, _ in C.VOCABULARY)}) t(p, card, kind, grp)),
t as (select id as mid, min({_US_SQL}) as at from messages group by id),
ev as (select a.id as cid, min("at") as e0, max("at") as e1 from (select id, unnest(evidence_message_ids) as e from claims) a join t on mid = e group by 1),
c as (
  select claims.id, conversation_id, subject_normalized, predicate, card, extracted_at, confidence, privacy_tier, evidence_message_ids as cited, e0, e1,
    case when card = 'single_current' then '' when object_text is not null then {_SUBJECT_SQL.format('object_text')}
      else trim(regexp_replace(lower(array_to_string([coalesce(json_extract_string(object_json, '$.' || k), '') for k in string_split(grp, ',') if k <> ''], chr(31))), '\\s+', ' ', 'g')) end as group_object_key,
    case when object_text is not null then 'text:' || {_SUBJECT_SQL.format('object_text')} else 'json:{{' || array_to_string(['"' || k || '":' || json_extract(object_json, '$.' || k)::varchar for k in list_sort(json_keys(object_json))], ',') || '}}' end as value
  from {_ACTIVE_CLAIMS_SQL} claims join v on v.p = claims.predicate left join ev on ev.cid = claims.id),
l as (select conversation_id as lc, max(extracted_at) as last_at from {_ACTIVE_CLAIMS_SQL} group by 1),
g as (
  select conversation_id, {_KEYS_SQL}, value, card, min(extracted_at) as first_at, first(id order by extracted_at, id) as first_id, min(e0) as begins, max(e1) as observed, count(*) as n, sum(confidence) as conf, max(privacy_tier) as tier,
    list(id order by extracted_at, id) as ids, flatten(list(cited)) as cited from c group by 1, 2, 3, 4, 5, 6),
o as (
  select g.*, row_number() over w as rn, lag(value) over w as lv from g join l on lc = conversation_id
  window w as (partition by {_KEYS_SQL} order by last_at, conversation_id, first_at, first_id)),
i as (select *, sum(case when rn = 1 or (card like 'single%' and lv is distinct from value) then 1 else 0 end) over (partition by {_KEYS_SQL} order by rn) as island from o),
b as (
  select {_KEYS_SQL}, island, first(first_id order by rn) as first_claim, first(value order by rn) as value, first(begins order by rn) as valid_from, max(observed) as observed_at, cast(sum(n) as bigint) as claims,
    round(sum(conf) / sum(n), 6) as confidence, max(tier) as tier, array_to_string(flatten(list(ids order by rn)), ',') as claim_ids, array_to_string(list_sort(list_distinct(flatten(list(cited)))), ',') as evidence_ids,
    last(n order by rn) as last_n, last(conf order by rn) as last_conf from i group by {_KEYS_SQL}, island),
d as (select *, lead(valid_from) over w as valid_to, lead(value) over w as contradicts from b window w as (partition by {_KEYS_SQL} order by island))""".replace("\\\\", "\\")

# ---- scans, filters, projections ----


@query("""
select id, subject_normalized, predicate, object_text, round(confidence, 6) as confidence, coalesce(status, 'unknown') as status from beliefs
where valid_to is null and (status is null or status in ('candidate', 'provisional', 'accepted')) and privacy_tier <= 2""")
def current_beliefs(spark, d):
    b = load(spark, d, "beliefs").where(F.col("valid_to").isNull() & (F.col("status").isNull() | F.col("status").isin("candidate", "provisional", "accepted")) & (F.col("privacy_tier") <= 2))
    return b.select("id", "subject_normalized", "predicate", "object_text", F.round("confidence", 6).alias("confidence"), F.coalesce("status", F.lit("unknown")).alias("status"))


@query("select id, conversation_id, sequence_index, len(message_ids) as messages from segments where is_active and invalidated_at is null and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null")
def active_segments(spark, d):
    s = load(spark, d, "segments").where("is_active and invalidated_at is null and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null")
    return s.select("id", "conversation_id", "sequence_index", F.size("message_ids").alias("messages"))


@query("select a.id from claims a join segments s on a.segment_id = s.id where len([x for x in a.evidence_message_ids if not list_contains(s.message_ids, x)]) = 0")
def evidence_contained(spark, d):
    s = load(spark, d, "segments").select(F.col("id").alias("segment_id"), "message_ids")
    return load(spark, d, "claims").join(s, "segment_id").where(F.size(F.array_except("evidence_message_ids", "message_ids")) == 0).select("id")


@query("select id, list_contains(json_keys(object_json), 'address_line1') as has_address, list_contains(json_keys(object_json), 'name') as has_name from claims where object_json is not null")
def json_key_flags(spark, d):
    k = F.json_object_keys("object_json")
    return load(spark, d, "claims").where("object_json is not null").select("id", F.array_contains(k, "address_line1").alias("has_address"), F.array_contains(k, "name").alias("has_name"))


@query("select item_id from corpus_rows where lower(provenance.path) = 'docs/commit/0000.md'")
def path_lookup(spark, d):
    return load(spark, d, "corpus_rows").where(F.lower("provenance.path") == "docs/commit/0000.md").select("item_id")


@query("""
select a.item_id, b.item_id as other_id from corpus_rows a join corpus_rows b
on a.tenant_id = b.tenant_id and a.corpus_id = b.corpus_id and a.external_id = b.external_id and a.export_timezone is not distinct from b.export_timezone and a.item_id < b.item_id""")
def same_external_null_safe(spark, d):
    a = load(spark, d, "corpus_rows").select("item_id", "tenant_id", "corpus_id", "external_id", "export_timezone")
    b = a.select(F.col("item_id").alias("other_id"), *(F.col(c).alias(f"o_{c}") for c in a.columns[1:]))
    on = (a.tenant_id == b.o_tenant_id) & (a.corpus_id == b.o_corpus_id) & (a.external_id == b.o_external_id) & a.export_timezone.eqNullSafe(b.o_export_timezone) & (a.item_id < b.other_id)
    return a.join(b, on).select("item_id", "other_id")


@query("select item_id, privacy_tier, sub_kind from corpus_rows where privacy_tier <= 1 and (tenant_id, corpus_id) in (('tenant-1', 'corpus-13'), ('tenant-2', 'corpus-11'), ('tenant-2', 'corpus-02'))")
def secure_rows(spark, d):
    return R.secure_view(load(spark, d, "corpus_rows"), [("tenant-1", "corpus-13"), ("tenant-2", "corpus-11"), ("tenant-2", "corpus-02")], 1).select("item_id", "privacy_tier", "sub_kind")


# ---- joins ----


@query("select c.id, s.generation_id, s.sequence_index, m.source_kind from claims c join segments s on c.segment_id = s.id join conversations m on c.conversation_id = m.id where s.is_active")
def claim_chain(spark, d):
    s = load(spark, d, "segments").where("is_active").select(F.col("id").alias("segment_id"), "generation_id", "sequence_index")
    v = load(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "source_kind")
    return load(spark, d, "claims").select("id", "segment_id", "conversation_id").join(s, "segment_id").join(v, "conversation_id").select("id", "generation_id", "sequence_index", "source_kind")


@query("select c.id, count(s.id) as segments from conversations c left join segments s on 'conversation:' || c.id = 'conversation:' || s.conversation_id group by c.id")
def scope_left_join(spark, d):
    s = load(spark, d, "segments").select(F.concat(F.lit("conversation:"), "conversation_id").alias("scope"))
    c = load(spark, d, "conversations").select("id", F.concat(F.lit("conversation:"), "id").alias("scope"))
    return c.join(s.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope", "left").select("id", F.coalesce("n", F.lit(0)).alias("segments"))


@query("select s.id from segments s where not exists (select 1 from claims c where c.segment_id = s.id)")
def pending_segments(spark, d):
    s = load(spark, d, "segments").select(F.col("id").alias("segment_id"))
    return R.pending(s, load(spark, d, "claims").select("segment_id").distinct(), ["segment_id"]).select(F.col("segment_id").alias("id"))


@query("select c.id from conversations c where not exists (select 1 from segments s where s.conversation_id = c.id and not exists (select 1 from claims k where k.segment_id = s.id))")
def complete_conversations(spark, d):
    parents = load(spark, d, "conversations").select(F.col("id").alias("conversation_id"))
    children = load(spark, d, "segments").select("conversation_id", F.col("id").alias("segment_id"))
    return R.complete(parents, children, load(spark, d, "claims").select("segment_id"), "conversation_id", "segment_id").select(F.col("conversation_id").alias("id"))


@query("select c.id from corpus_rows r join (select item_id as id, export_timezone, sub_kind from corpus_rows) c on c.id = r.item_id where exists (select 1 from ingest_results i where i.export_timezone is not distinct from c.export_timezone)")
def answered_null_safe(spark, d):
    c = load(spark, d, "corpus_rows").select(F.col("item_id").alias("id"), "export_timezone")
    return R.answered(c, load(spark, d, "ingest_results").select("export_timezone").distinct(), ["export_timezone"]).select("id")


@query("select c.id, m.id as message_id, m.role from (select id, unnest(list_distinct(evidence_message_ids)) as e from claims) c join messages m on m.id = c.e")
def claim_evidence(spark, d):
    m = load(spark, d, "messages").select(F.col("id").alias("message_id"), "role")
    return R.members(load(spark, d, "claims"), "evidence_message_ids", m, "message_id", ["id"])


@query("""
select node, count(*) as links from (select subject_normalized as node, id from beliefs union select lower(object_text), id from beliefs where object_text is not null)
where node is not null group by node having count(*) > 3""")
def either_end_counts(spark, d):
    b = load(spark, d, "beliefs").select("id", F.col("subject_normalized").alias("a"), F.lower("object_text").alias("b"))
    return R.either_end(b, "a", "b", "id").where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("links")).where("links > 3")


@query("""
select b.id, count(distinct c) as cited, count(distinct k.id) as known from (select id, unnest(claim_ids) as c from beliefs) b left join claims k on k.id = b.c group by b.id""")
def belief_claims_known(spark, d):
    b = load(spark, d, "beliefs").select("id", F.explode("claim_ids").alias("c"))
    k = load(spark, d, "claims").select(F.col("id").alias("c"), F.col("id").alias("k"))
    return b.join(k, "c", "left").groupBy("id").agg(F.count_distinct("c").alias("cited"), F.count_distinct("k").alias("known"))


@query(f'select id, min("at") as first_us, max("at") as last_us from (select id, unnest(list_distinct(evidence_message_ids)) as e from claims) c join (select id as m, min({_US_SQL}) as at from messages group by id) on m = e group by id')
def evidence_interval(spark, d):
    return C.evidence_interval(load(spark, d, "claims"), load(spark, d, "messages"))


@query("select position, item_id, sub_kind from (select * from corpus_rows order by item_id limit 5) join (select item_id as i, row_number() over (order by item_id desc) - 1 as position from (select item_id from corpus_rows order by item_id limit 5)) on i = item_id")
def list_order(spark, d):
    rows = load(spark, d, "corpus_rows")
    ids = [r[0] for r in rows.select("item_id").orderBy("item_id").limit(5).collect()]
    return R.in_list_order(rows.select("item_id", "sub_kind"), "item_id", ids[::-1]).select("position", "item_id", "sub_kind")


# ---- aggregations ----


@query("select source_kind, role, count(*) as messages, count(distinct conversation_id) as conversations from messages group by source_kind, role")
def role_counts(spark, d):
    return load(spark, d, "messages").groupBy("source_kind", "role").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conversation_id").alias("conversations"))


@query("""
select tenant_id, corpus_id, count(*) as items, max(recorded_at) as latest, min(recorded_at) as earliest, count(distinct external_id) as external_ids,
  array_to_string(list_sort(list_distinct(list(sub_kind))), ',') as sub_kinds from corpus_rows group by tenant_id, corpus_id""")
def describe_corpus(spark, d):
    return S.describe(load(spark, d, "corpus_rows"))


@query("select predicate, stability_class, round(avg(confidence), 6) as mean, max(confidence) as max, min(confidence) as min, count(confidence) as n, round(stddev_pop(confidence), 6) as stddev from claims group by predicate, stability_class")
def confidence_stats(spark, d):
    return C.confidence_stats(load(spark, d, "claims"), ["predicate", "stability_class"])


@query("select segment_id, predicate, count(*) as claims, sum(len(evidence_message_ids)) as evidence from claims group by segment_id, predicate")
def predicate_distribution(spark, d):
    return load(spark, d, "claims").groupBy("segment_id", "predicate").agg(F.count(F.lit(1)).alias("claims"), F.sum(F.size("evidence_message_ids")).alias("evidence"))


@query("select segment_id, count(*) as claims, array_to_string(list_sort(list_distinct(list(predicate))), ',') as predicates, bool_or(object_json is not null) as any_json from claims group by segment_id")
def segment_summary(spark, d):
    return load(spark, d, "claims").groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.bool_or(F.col("object_json").isNotNull()).alias("any_json")
    )


@query("select coalesce(export_timezone, '<none>') as zone, count(*) as batches, sum(messages_seen) as seen, sum(coalesce(messages_inserted, 0)) as inserted from ingest_results group by 1")
def zone_counts(spark, d):
    return load(spark, d, "ingest_results").groupBy(F.coalesce("export_timezone", F.lit("<none>")).alias("zone")).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("messages_seen").alias("seen"), F.sum(F.coalesce("messages_inserted", F.lit(0))).alias("inserted")
    )


@query("select source_kind, cast(round_even(quantile_cont(n, 0.1), 0) as bigint) as p10, cast(round_even(quantile_cont(n, 0.5), 0) as bigint) as p50, cast(round_even(quantile_cont(n, 0.9), 0) as bigint) as p90 from (select source_kind, length(content_text) as n from messages where content_text is not null) group by source_kind")
def length_percentiles(spark, d):
    m = load(spark, d, "messages").where("content_text is not null").select("source_kind", F.length("content_text").alias("n"))
    return E.percentiles(m, "n", ["source_kind"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("""
with a as (select coalesce(predicate, '<none>') as k, count(*) / sum(count(*)) over () as p from claims group by 1),
b as (select coalesce(predicate, '<none>') as k, count(*) / sum(count(*)) over () as p from beliefs group by 1)
select round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) as l1 from a full join b on a.k = b.k""")
def predicate_l1(spark, d):
    return R.distribution_l1(load(spark, d, "claims"), load(spark, d, "beliefs"), "predicate")


@query("""
select predicate, round(avg(case when object_text is not null then 1.0 else 0.0 end), 6) as object_text_rate, round(avg(case when object_json is not null then 1.0 else 0.0 end), 6) as object_json_rate,
  round(avg(case when len(evidence_message_ids) > 0 then 1.0 else 0.0 end), 6) as evidence_rate from claims group by predicate""")
def field_presence(spark, d):
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return load(spark, d, "claims").groupBy("predicate").agg(
        rate(F.col("object_text").isNotNull()).alias("object_text_rate"), rate(F.col("object_json").isNotNull()).alias("object_json_rate"), rate(F.size("evidence_message_ids") > 0).alias("evidence_rate")
    )


@query("select array_to_string(list(id order by sequence_index, id), ',') as ids, conversation_id from segments where is_active group by conversation_id")
def ordered_segment_ids(spark, d):
    s = load(spark, d, "segments").where("is_active").groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence_index", "id"))).alias("x"))
    return s.select(F.array_join(F.col("x.id"), ",").alias("ids"), "conversation_id")


# ---- latest rows, order, limits ----


@query("select subject_normalized, predicate, group_object_key, id, status from beliefs qualify row_number() over (partition by subject_normalized, predicate, group_object_key order by recorded_at desc, id desc) = 1")
def latest_belief_reports(spark, d):
    b = load(spark, d, "beliefs").select("subject_normalized", "predicate", "group_object_key", "id", "status", "recorded_at")
    return R.latest_by_max(b, ["subject_normalized", "predicate", "group_object_key"], ["recorded_at", "id"]).drop("recorded_at")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def latest_event_per_key(spark, d):
    e = load(spark, d, "events")
    return R.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("select id, title, updated_at from conversations order by updated_at desc nulls last, id limit 25")
def newest_conversations(spark, d):
    return load(spark, d, "conversations").orderBy(F.desc_nulls_last("updated_at"), "id").limit(25).select("id", "title", "updated_at")


@query("select doc_id, source from documents order by sha256('seed-7|' || doc_id::varchar), doc_id limit 40")
def hash_sample(spark, d):
    return R.hash_sample(load(spark, d, "documents").select("doc_id", "source"), "doc_id", 40, "seed-7")


@query("""
select segment_id, source_kind, turn from (select id as segment_id, source_kind, row_number() over (partition by source_kind order by sha256('slice|' || id), id) as turn from segments where is_active)
where turn <= 30 order by turn, source_kind, segment_id limit 30""")
def balanced_slice(spark, d):
    s = load(spark, d, "segments").where("is_active").select(F.col("id").alias("segment_id"), "source_kind")
    return R.round_robin(s, ["source_kind"], "segment_id", 30, "slice").select("segment_id", "source_kind", "turn")


# ---- set operations ----


@query("select 'claim' as kind, id, privacy_tier from claims where confidence >= 0.5 union all select 'belief', id, privacy_tier from beliefs where confidence >= 0.5")
def candidate_pool(spark, d):
    part = lambda t, k: load(spark, d, t).where("confidence >= 0.5").select(F.lit(k).alias("kind"), "id", "privacy_tier")
    return part("claims", "claim").unionByName(part("beliefs", "belief"))


@query("select distinct subject_normalized from claims except select distinct subject_normalized from beliefs")
def subjects_without_belief(spark, d):
    return load(spark, d, "claims").select("subject_normalized").subtract(load(spark, d, "beliefs").select("subject_normalized"))


# ---- scalar functions ----


@query(r"""
select id, regexp_replace(trim(regexp_replace(lower(subject_text), '\s+', ' ', 'g')), '[.,;:!?]+$', '') as subject, trim(regexp_replace(lower(object_text), '\s+', ' ', 'g')) as object
from claims where object_text is not null and subject_text is not null""")
def normalized_claims(spark, d):
    c = load(spark, d, "claims").where("object_text is not null and subject_text is not null")
    return c.select("id", T.normalize_subject(F.col("subject_text")).alias("subject"), T.normalize_value(F.col("object_text")).alias("object"))


@query("select id, case when coalesce(length(content_text), 0) = 0 then 0 else greatest(1, cast(ceil(length(content_text) / 2.5) as integer)) end as tokens from messages")
def token_estimates(spark, d):
    return load(spark, d, "messages").select("id", T.token_estimate(F.col("content_text")).alias("tokens"))


@query("select doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(source, '')) as digest from documents")
def content_hashes(spark, d):
    return load(spark, d, "documents").select("doc_id", T.joined_hash(F.col("text"), F.col("source")).alias("digest"))


@query(r"select id, case when s = '' then 'section' else s end as slug from (select id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') as s from conversations where title is not null)")
def title_slugs(spark, d):
    return load(spark, d, "conversations").where("title is not null").select("id", T.slugify(F.col("title")).alias("slug"))


@query("select id, case when length(content_text) > 80 then regexp_replace(substr(content_text, 1, 80), '\\s+$', '') || '…' else content_text end as excerpt from messages where content_text is not null")
def excerpts(spark, d):
    return load(spark, d, "messages").where("content_text is not null").select("id", T.excerpt(F.col("content_text"), 80).alias("excerpt"))


@query("""
select id, case when confidence < 0.25 then 'low' when confidence < 0.5 then 'medium_low' when confidence < 0.75 then 'medium_high' when confidence <= 1 then 'high' end as band,
  case when date_diff('day', extracted_at, timestamp '2026-01-01') < 7 then 'week' when date_diff('day', extracted_at, timestamp '2026-01-01') < 30 then 'month'
    when date_diff('day', extracted_at, timestamp '2026-01-01') < 90 then 'quarter' when date_diff('day', extracted_at, timestamp '2026-01-01') < 365 then 'year' else 'older' end as recency from claims""")
def claim_bands(spark, d):
    return load(spark, d, "claims").select("id", T.confidence_band(F.col("confidence")).alias("band"), T.recency_band(F.col("extracted_at"), F.to_timestamp(F.lit("2026-01-01"))).alias("recency"))


@query(r"select item_id, regexp_extract_all(lower(content), '([a-z0-9][a-z0-9_\-:#./]+)').len() as tokens from corpus_rows where content is not null")
def query_token_counts(spark, d):
    return load(spark, d, "corpus_rows").where("content is not null").select("item_id", F.size(T.query_tokens(F.col("content"))).alias("tokens"))


@query()
def canonical_objects(spark, d):
    return load(spark, d, "claims").where("object_json is not null").select("id", F.sha2(T.canonical_json(F.col("object_json")), 256).alias("digest"), T.has_content_key(F.col("object_json")).alias("has_content"))


@query()
def opaque_references(spark, d):
    c = load(spark, d, "corpus_rows").select("item_id", "tenant_id", T.opaque_id(F.struct("corpus_id", "item_id", "tenant_id")).alias("reference"))
    back = T.opened_id(F.col("reference"), "corpus_id string, item_id string, tenant_id string")
    return c.select("item_id", "reference", (back["item_id"] == F.col("item_id")).alias("round_trip"))


@query()
def embeddable_segments(spark, d):
    return load(spark, d, "segments").select("id", F.length(T.embeddable(F.col("content_text"))).alias("chars"), F.length(T.normalize_fragment(F.col("content_text"))).alias("fragment_chars"))


@query(r"select id, case when sum_text is null then 0 else len(string_split(trim(regexp_replace(sum_text, '\s+', ' ', 'g')), ' ')) end as words from (select id, summary_text as sum_text from segments) where sum_text is not null and trim(sum_text) <> ''")
def summary_words(spark, d):
    return load(spark, d, "segments").where("summary_text is not null and trim(summary_text) <> ''").select("id", T.words(F.col("summary_text")).alias("words"))


# ---- graph ----


@query(r"""
with r as (
  select id, 0 as role, 'subject:' || subject_normalized as key, subject_text as label from beliefs
  union all select id, 1, case when object_text is not null then 'object:' || trim(regexp_replace(lower(object_text), '\s+', ' ', 'g'))
    when coalesce(group_object_key, '') <> '' then 'object:' || predicate || ':' || group_object_key end, coalesce(object_text, group_object_key) from beliefs)
select key, first(label order by id, role) as label, min(id) as belief_id, count(*) as mentions from r where key is not null group by key""")
def entities(spark, d):
    return G.entities(G.entity_rows(load(spark, d, "beliefs")))


@query(r"""
with b as (select id, predicate, 'subject:' || subject_normalized as s, case when object_text is not null then 'object:' || trim(regexp_replace(lower(object_text), '\s+', ' ', 'g'))
    when coalesce(group_object_key, '') <> '' then 'object:' || predicate || ':' || group_object_key end as o from beliefs)
select s as source, o as target, predicate as kind, min(id) as belief_id from b where o is not null and s is not null group by s, o, predicate""")
def entity_edges(spark, d):
    b = load(spark, d, "beliefs")
    return G.edges(G.entity_rows(b), b)


@query("""
with e as (select distinct n_nationkey as a, 100 + n_regionkey as b from nation), g as (select a, b from e union select b, a from e),
one as (select 0 as origin, b as node from g where a = 0)
select origin, node, 1 as depth from one union all select distinct 0, g.b, 2 from one join g on g.a = one.node where g.b <> 0""")
def nation_neighbourhood(spark, d):
    links = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_regionkey") + 100).cast("long").alias("target"))
    return G.neighbourhood(links, spark.range(1).select(F.col("id").alias("node")), 2)


@query("""
with recursive l as (select distinct s_suppkey as n, s_suppkey + 1 as h from supplier where s_suppkey % 7 <> 0), c as (select n, h from l union all select c.n, l.h from c join l on l.n = c.h)
select n as node, max(h) as head from c group by n""")
def supersession_heads(spark, d):
    links = load(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").cast("long").alias("node"), (F.col("s_suppkey") + 1).cast("long").alias("next")).distinct()
    return G.chain_heads(links, "node", "next")


@query("""
with e as (select distinct id, recorded_at, subject_normalized as s, predicate as p, group_object_key as g from beliefs)
select id as node, head from (select id, last(id) over w as head, row_number() over (partition by s, p, g order by recorded_at desc, id desc) as back from e
  window w as (partition by s, p, g order by recorded_at, id rows between unbounded preceding and unbounded following)) where back > 1""")
def belief_chain_heads(spark, d):
    w = Window.partitionBy("subject_normalized", "predicate", "group_object_key").orderBy("recorded_at", "id")
    links = load(spark, d, "beliefs").select("id", "recorded_at", "subject_normalized", "predicate", "group_object_key").distinct().select(F.col("id").alias("node"), F.lead("id").over(w).alias("next"))
    return G.chain_heads(links.where("next is not null"), "node", "next")


@query(r"""
with b as (select 'subject:' || subject_normalized as s, case when object_text is not null then 'object:' || trim(regexp_replace(lower(object_text), '\s+', ' ', 'g'))
    when coalesce(group_object_key, '') <> '' then 'object:' || predicate || ':' || group_object_key end as o from beliefs),
e as (select distinct s, o from b where o is not null and s is not null), g as (select s as a, o as b from e union select o, s from e), one as (select b as node from g where a = 'subject:user')
select 'subject:user' as origin, node, 1 as depth from one union all select distinct 'subject:user', g.b, 2 from one join g on g.a = one.node where g.b <> 'subject:user'""")
def entity_neighbourhood(spark, d):
    return G.neighbourhood(entity_edges(spark, d), spark.createDataFrame([("subject:user",)], "node string"), 2)


# ---- retrieval ----

_TERMS = "belief history index"


def _score_sql(hay: str, query: str) -> str:
    toks = S.tokens_of(query)
    parts = [f"case when contains({hay}, '{' '.join(toks)}') then 5.0 else 0.0 end"]
    parts += [f"least(5, cast((length({hay}) - length(replace({hay}, '{t}', ''))) / {len(t)} as integer))" for t in toks]
    parts += [f"case when contains({hay}, '{t}') then 0.25 else 0.0 end" for t in sorted(set(toks))]
    return f"round({' + '.join(parts)}, 4)"


@query(f"""
with r as (select *, lower(concat_ws(' ', coalesce(content, ''), coalesce(external_id, ''), coalesce(sub_kind, ''), coalesce(provenance.path, ''), coalesce(provenance.commit_sha, ''))) as hay
  from corpus_rows order by recorded_at desc, external_id, item_id limit 1000)
select item_id, external_id, cast({_score_sql('hay', _TERMS)} as double) as score from r where {_score_sql('hay', _TERMS)} > 0 order by score desc, external_id, item_id limit 20""")
def lexical_search(spark, d):
    return S.search(load(spark, d, "corpus_rows"), _TERMS, 20).select("item_id", "external_id", F.col("score").cast("double").alias("score"))


@query(f"""
with r as (select *, lower(concat_ws(' ', coalesce(content, ''), coalesce(external_id, ''), coalesce(sub_kind, ''), coalesce(provenance.path, ''), coalesce(provenance.commit_sha, ''))) as hay
  from corpus_rows qualify row_number() over (partition by tenant_id, corpus_id order by recorded_at desc, external_id, item_id) <= 1000),
s as (select tenant_id, corpus_id, item_id, external_id, cast({_score_sql('hay', _TERMS)} as double) as score from r)
select *, row_number() over (partition by tenant_id, corpus_id order by score desc, external_id, item_id) as rank from s where score > 0 qualify rank <= 20""")
def lexical_search_each(spark, d):
    hits = S.search_each(load(spark, d, "corpus_rows"), _TERMS, 20)
    return hits.select("tenant_id", "corpus_id", "item_id", "external_id", F.col("score").cast("double").alias("score"), "rank")


@query()
def derived_references(spark, d):
    return S.references(load(spark, d, "corpus_rows"))


@query("""
select item_id, array_to_string(list_sort(list_distinct(list(k))), ',') as matched from (
  select item_id, 'path' as k, lower(trim(provenance.path)) as v from corpus_rows union all select item_id, 'commit_sha', lower(trim(provenance.commit_sha)) from corpus_rows)
where (k, v) in (('path', 'docs/commit/0000.md'), ('path', 'docs/commit/0002.md'), ('commit_sha', '42f87fa9bc')) group by item_id""")
def exact_references(spark, d):
    refs = S.references(load(spark, d, "corpus_rows"))
    return S.lookup(refs, [("path", "docs\\commit\\0000.md"), ("path", "Docs/commit/0002.md"), ("commit_sha", "42F87FA9BC")])


@query()
def packet(spark, d):
    return S.packet(S.search_each(load(spark, d, "corpus_rows"), "the belief history", 50), 300, keys=("tenant_id", "corpus_id"))


@query()
def corpus_manifest(spark, d):
    return S.manifest(load(spark, d, "corpus_rows"))


@query("select input_sha256, embedding_model_version, first(cache_id order by created_at, cache_id) as cache_id, count(*) as entries from embedding_cache group by input_sha256, embedding_model_version")
def embedding_cache_unique(spark, d):
    return S.cached_embeddings(load(spark, d, "embedding_cache"))


@query("select distinct input_sha256 from embedding_cache a where not exists (select 1 from embedding_cache b where b.input_sha256 = a.input_sha256 and b.embedding_model_version = 'textvec-96.v2')")
def embedding_misses(spark, d):
    c = load(spark, d, "embedding_cache")
    return S.embedding_misses(c, c, "textvec-96.v2")


@query("""
select query_id, vec_id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from (
  select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id in (0, 100, 200)))
where rank <= 5""")
def vector_top_k(spark, d):
    return S.top_similar(load(spark, d, "embeddings"), [0, 100, 200], 5)


@query("""
select query_id, vec_id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from (
  select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0))
where rank <= 5""")
def vector_top_k_hundreds(spark, d):
    v = load(spark, d, "embeddings")
    return S.top_similar_to(v, v.where("vec_id % 100 = 0"), 5)


@query("""
select item_id, case when redaction_state = 'dirty' then 'dirty_working_tree' when sub_kind <> 'unknown' then sub_kind when redaction_state is not null then 'fresh' else 'unknown' end as freshness
from corpus_rows""")
def freshness_labels(spark, d):
    c = load(spark, d, "corpus_rows").withColumn("dirty", F.col("redaction_state") == "dirty").withColumn("none", F.lit(None).cast("string"))
    return c.select("item_id", S.freshness(c, "dirty", "none", "sub_kind").alias("freshness"))


# ---- segmentation ----


@query(_greedy_sql(f"select conversation_id as k, sequence_index as pos, {_TOKENS_SQL} as size from {_ORDERED_SQL}", 200, "k as conversation_id, pos as sequence_index, segment"))
def fixed_token_segments(spark, d):
    return SG.fixed_windows(_sized(spark, d))


@query(_greedy_sql(f"select k, unit as pos, sum(size) as size from ({_UNITS_SQL}) group by k, unit", 200, "k as conversation_id, q as sequence_index, segment", f"join ({_UNITS_SQL}) u using (k) where u.unit = r.pos"))
def message_group_segments(spark, d):
    return SG.message_groups(_sized(spark, d))


@query(_greedy_sql(f"select conversation_id as k, sequence_index as pos, least(4000, {_PROMPT_SQL}) as size from {_ORDERED_SQL}", 4000, '"window", k as conversation_id, pos as sequence_index, truncated', f'join (select conversation_id as k, sequence_index as pos, {_PROMPT_SQL} > 4000 as truncated from {_ORDERED_SQL}) using (k, pos)').replace('select "window"', 'select segment as "window"'))
def windows_by_budget(spark, d):
    return SG.windows_by_budget(_ordered(spark, d), 4000)


@query(f"""
select s.id as span_id, m.id as message_id, m.sequence_index from (
  select s.id, s.conversation_id, min(m.sequence_index) as lo, max(m.sequence_index) as hi from (select id, conversation_id, unnest(message_ids) as e from segments where is_active) s
  join messages m on m.id = s.e and m.conversation_id = s.conversation_id where m.sequence_index is not null group by 1, 2) s
join {_ORDERED_SQL} m on m.conversation_id = s.conversation_id and m.sequence_index between s.lo and s.hi""")
def expanded_spans(spark, d):
    m = load(spark, d, "messages").where("sequence_index is not null").select(F.col("id").alias("e"), F.col("conversation_id").alias("c"), "sequence_index")
    s = load(spark, d, "segments").where("is_active").select(F.col("id").alias("span_id"), "conversation_id", F.explode("message_ids").alias("e")).join(m, "e").where("c = conversation_id")
    return SG.expand_spans(s.groupBy("span_id", "conversation_id").agg(F.min("sequence_index").alias("lo"), F.max("sequence_index").alias("hi")), _ordered(spark, d))


@query("""
select s.id, greatest(max(m.privacy_tier), max(c.privacy_tier)) as tier from (select id, conversation_id, unnest(case when len(message_ids) > 0 then message_ids else [null] end) as e from segments) s
left join messages m on m.id = s.e left join conversations c on c.id = s.conversation_id group by s.id""")
def segment_tiers(spark, d):
    return SG.segment_tier(load(spark, d, "segments"), load(spark, d, "messages"), load(spark, d, "conversations"))


@query("""
with e as (select id, conversation_id, unnest(message_ids) as m, generate_subscripts(message_ids, 1) as pos from segments),
r as (select e.*, m.id as known, m.conversation_id as c, m.sequence_index as q, max(m.sequence_index) over (partition by e.id order by pos rows between unbounded preceding and 1 preceding) as before from e left join messages m on m.id = e.m),
f as (select s.id, count(r.pos) as n, bool_or(r.pos is not null and known is null) as unknown, bool_or(c <> r.conversation_id) as foreign_, bool_or(q < before) as late from segments s left join r on r.id = s.id group by s.id)
select id, case when n = 0 then 'empty' when unknown then 'unknown message' when foreign_ then 'other conversation' when late then 'out of order' end as defect from f
where n = 0 or unknown or coalesce(foreign_, false) or coalesce(late, false)""")
def segment_span_defects(spark, d):
    return SG.span_defects(load(spark, d, "segments"), load(spark, d, "messages"))


@query(f"""
select a.id, m.id as message_id, m.sequence_index - a.at as offset from (select c.id, x.conversation_id, x.sequence_index as at from claims c join messages x on x.id = c.evidence_message_ids[1] where x.sequence_index is not null and c.predicate = 'lives_at') a
join {_ORDERED_SQL} m on m.conversation_id = a.conversation_id and m.sequence_index between a.at - 2 and a.at + 2""")
def context_windows(spark, d):
    m = load(spark, d, "messages").where("sequence_index is not null").select(F.col("id").alias("e"), "conversation_id", F.col("sequence_index").alias("at"))
    a = load(spark, d, "claims").where("predicate = 'lives_at'").select("id", F.get("evidence_message_ids", F.lit(0)).alias("e")).join(m, "e")
    spans = a.select(F.struct("id", "at").alias("span_id"), "conversation_id", (F.col("at") - 2).alias("lo"), (F.col("at") + 2).alias("hi"))
    return SG.expand_spans(spans, _ordered(spark, d)).select("span_id.id", "message_id", (F.col("sequence_index") - F.col("span_id.at")).alias("offset"))


@query()
def evidence_context_windows(spark, d):
    m = load(spark, d, "messages").where("sequence_index is not null").select(F.col("id").alias("e"), "conversation_id", F.col("sequence_index").alias("at"))
    cited = load(spark, d, "claims").select("id", F.explode(F.array_distinct("evidence_message_ids")).alias("e"))
    spans = m.join(cited.select("e").distinct(), "e", "left_semi").select(F.struct("e", "at").alias("span_id"), "conversation_id", (F.col("at") - 2).alias("lo"), (F.col("at") + 2).alias("hi"))
    windows = SG.expand_spans(spans, _ordered(spark, d)).select("span_id.e", "message_id", (F.col("sequence_index") - F.col("span_id.at")).alias("offset"))
    return cited.join(windows, "e").select("id", F.col("e").alias("evidence_id"), "message_id", "offset")


def _two_segmentations(spark, d):
    m = stage(_sized(spark, d), "sized")
    n = m.groupBy("conversation_id").agg(F.max("sequence_index").alias("hi"))
    a = E.boundaries(SG.message_groups(m)).withColumnRenamed("boundaries", "expected")
    b = E.boundaries(SG.fixed_windows(m)).withColumnRenamed("boundaries", "predicted")
    ints = lambda c: F.transform(c, lambda x: x.cast("int")).alias(c)
    return a.join(b, "conversation_id").join(n, "conversation_id").select("conversation_id", ints("expected"), ints("predicted"), (F.col("hi") + 1).cast("int").alias("n"))


@query()
def boundary_scores(spark, d):
    s = E.segmentation_scores(_measured(spark, d))
    r6 = lambda c: F.round(c, 6).alias(c)
    return s.select("conversation_id", r6("precision"), r6("recall"), r6("f1"), F.col("within").alias("within_1"), r6("pk"), r6("windowdiff"))


@query()
def split_rates(spark, d):
    return E.split_rates(_two_segmentations(spark, d))


@query(rf"""
with s as (select conversation_id, sequence_index, {_TOKENS_SQL} as tokens, content_text as raw from segments where is_active),
n as (select *, lead(tokens) over w as next_tokens from s window w as (partition by conversation_id order by sequence_index))
select count(*) as segments, round(avg((tokens < 50)::int), 6) as sub_50_rate, round(avg((tokens < 100)::int), 6) as sub_100_rate, round(avg((tokens < 200)::int), 6) as sub_200_rate, count(next_tokens) as pairs,
  coalesce(round(avg((tokens < 100 and next_tokens < 100)::int) filter (where next_tokens is not null), 6), 0) as tiny_pair_rate from n""".strip())
def segment_pairs(spark, d):
    return fragmentation(spark, d).drop("duplicate_pair_rate")


@query()
def fragmentation(spark, d):
    s = load(spark, d, "segments").where("is_active")
    return E.fragmentation(s.select("conversation_id", F.col("sequence_index").alias("segment"), T.token_estimate(F.col("content_text")).alias("tokens"), T.normalize_fragment(F.col("content_text")).alias("text")))


# ---- claims and beliefs ----


@query(f"""
select c.id, case when trim(coalesce(subject_text, '')) = '' then 'subject_text is empty' when v.kind is null then 'unknown predicate: ' || c.predicate
  when stability_class is distinct from v.stability then 'stability_class does not match the vocabulary' when coalesce(len(evidence_message_ids), 0) = 0 then 'evidence is empty'
  when len([x for x in evidence_message_ids if not list_contains(coalesce(s.message_ids, []), x)]) > 0 then 'evidence outside of the segment'
  when (object_text is null) = (object_json is null) then 'exactly one object is required' when v.kind = 'text' and trim(coalesce(object_text, '')) = '' then 'predicate requires object_text'
  when v.kind = 'json' and (object_json is null or ltrim(object_json)[1] <> '{{') then 'predicate requires object_json'
  when v.kind = 'json' and len([x for x in string_split(v.required, ',') if x <> '' and not list_contains(json_keys(object_json), x)]) > 0
    then 'object_json lacks ' || [x for x in string_split(v.required, ',') if x <> '' and not list_contains(json_keys(object_json), x)][1] end as reason
from claims c left join {_VOCABULARY_SQL} on v.predicate = c.predicate left join segments s on s.id = c.segment_id""")
def claim_defects(spark, d):
    return C.validate(load(spark, d, "claims"), load(spark, d, "segments"))


@query(f"select count(*) - count(reason) as inserted, count(reason) as dropped, round(count(reason) / count(*), 6) as drop_rate from ({_SQL['claim_defects']})")
def claim_drop_rate(spark, d):
    return C.drop_rate(C.validate(load(spark, d, "claims"), load(spark, d, "segments")))


@query("""
select id, predicate, stability_class, case when object_text is null then 'null' else 'text' end as object_text_type, case when object_json is null then 'null' else 'object' end as object_json_type,
  coalesce(array_to_string(list_sort(json_keys(object_json)), ','), '') as object_keys, coalesce(len(evidence_message_ids), 0) as evidence from claims""")
def claim_shapes(spark, d):
    return C.object_shape(load(spark, d, "claims"))


@query()
def extraction_chunks(spark, d):
    m = load(spark, d, "messages").select(F.col("id").alias("e"), F.coalesce(F.length("content_text"), F.lit(0)).alias("n_chars"))
    s = load(spark, d, "segments").select(F.col("id").alias("segment_id"), F.posexplode("message_ids").alias("at", "e"))
    return C.chunks(s.join(m, "e").select("segment_id", "at", F.col("n_chars").cast("long").alias("n_chars")), 4, 500)


def _evidence_claims(spark, d):
    c = C.active_claims(load(spark, d, "claims"), load(spark, d, "segments"))
    return C.traced(c, C.export_times(c, load(spark, d, "messages")))


@query(f"with {_CONSOLIDATED_SQL} select {_KEYS_SQL}, first_claim, value, valid_from, valid_to, claims, confidence, tier, contradicts, observed_at, claim_ids, evidence_ids from d")
def consolidated_beliefs(spark, d):
    b = C.consolidate(_evidence_claims(spark, d))
    return b.withColumn("claim_ids", F.array_join("claim_ids", ",")).withColumn("evidence_ids", F.array_join(F.array_sort("evidence_ids"), ","))


@query(f"""with {_CONSOLIDATED_SQL}, p as (select *, lead(valid_from) over (partition by {_KEYS_SQL} order by island) as next_from from d)
select {_KEYS_SQL}, value, contradicts, valid_to as at, coalesce(valid_to <= next_from, false) as apart from p where contradicts is not null""")
def belief_contradictions(spark, d):
    return C.contradictions(C.consolidate(_evidence_claims(spark, d)))


@query(f"""with {_CONSOLIDATED_SQL}, f as (select i.*, first(first_id) over (partition by {_KEYS_SQL}, island order by rn) as belief, rn = min(rn) over (partition by {_KEYS_SQL}, island) as starts from i)
select {_KEYS_SQL}, belief, first_id as group, case when starts then 'insert' else 'supersede' end as step, case when starts then null else 'candidate' end as previous_status,
  case when starts then 'candidate' else 'superseded' end as new_status, cast(null as bigint) as valid_to, n as claims, round(conf / n, 6) as mean from f
union all select {_KEYS_SQL}, first_claim, first_claim, 'close', 'candidate', 'superseded', valid_to, last_n, round(last_conf / last_n, 6) from d where contradicts is not null""".replace("as group,", 'as "group",'))
def belief_audit(spark, d):
    return C.audit(_evidence_claims(spark, d))


def _traced_beliefs(spark, d):
    c = C.active_claims(load(spark, d, "claims"), load(spark, d, "segments"))
    return C.consolidate(C.traced(c, C.evidence_times(c, load(spark, d, "messages"), load(spark, d, "ingest_results"))))


@query()
def traced_beliefs(spark, d):
    return _traced_beliefs(spark, d).withColumns({c: epoch_us(c) for c in ("valid_from", "valid_to", "observed_at")})


@query()
def traced_contradictions(spark, d):
    return C.contradictions(_traced_beliefs(spark, d)).withColumn("at", epoch_us("at"))


@query()
def traced_transitions(spark, d):
    return V.transitions(_traced_beliefs(spark, d)).withColumn("at", epoch_us("at"))


@query(f"""
with act as (select distinct id from {_ACTIVE_CLAIMS_SQL}),
r as (select b.id as belief_id, object_text as held, cardinality_class as card, c, list_position(claim_ids, c) as pos from (select *, unnest(list_distinct(claim_ids)) as c from beliefs where valid_to is null and status in ('candidate', 'provisional', 'accepted')) b),
x as (select r.*, act.id is null as lost, s.invalidated_at is not null as gone, s.is_active, k.object_text as text from r left join act on act.id = r.c left join claims k on k.id = r.c left join segments s on s.id = k.segment_id),
y as (select belief_id, any_value(held) as held, any_value(card) as card, count(*) filter (where lost) as lost, count(*) filter (where not lost) as kept, coalesce(bool_or(lost and gone), false) as gone, coalesce(bool_or(lost and not is_active and not gone), false) as off,
  (list(text order by pos) filter (where not lost))[1] as left_text from x group by belief_id having count(*) filter (where lost) > 0)
select belief_id, lost, kept, case when gone then 'reclassified' when off then 'deactivated' else 'reextraction' end as cause,
  case when not gone or kept = 0 then 'reject' when card in ('multi_current', 'event') or {_SUBJECT_SQL.format("coalesce(held, '')")} = {_SUBJECT_SQL.format("coalesce(left_text, '')")} then 'supersede' else 'contradict' end as decision from y""")
def orphan_decisions(spark, d):
    return C.orphan_decisions(load(spark, d, "beliefs"), load(spark, d, "claims"), load(spark, d, "segments"))


@query("""
select belief_id, count(*) filter (where k.id is null) as lost, count(k.id) as left from (select id as belief_id, unnest(list_distinct(claim_ids)) as c from beliefs) b
left join (select id from claims where confidence >= 0.2) k on k.id = b.c group by belief_id having count(*) filter (where k.id is null) > 0""")
def orphaned_beliefs(spark, d):
    return C.orphaned(load(spark, d, "beliefs"), load(spark, d, "claims").where("confidence >= 0.2"))


# ---- review ----


@query("""
with l as (select a.id as a, b.id as b from beliefs a join beliefs b on a.subject_normalized = b.subject_normalized and a.predicate = b.predicate and a.group_object_key = b.group_object_key
  and a.valid_from = b.valid_from and a.object_text <> b.object_text and a.id < b.id),
e as (select id, count(*) as n from (select a as id from l union all select b from l) group by id),
g as (select b.id, count(*) as n from (select id, unnest(list_distinct(claim_ids)) as c from beliefs) b join (select id from claims where confidence < 0.1) k on k.id = b.c group by b.id)
select b.id, coalesce(e.n, 0) as contradictions, coalesce(g.n, 0) as invalidated, cast(case when coalesce(e.n, 0) > 0 then 100 else 0 end + case when coalesce(g.n, 0) > 0 then 50 else 0 end
  + case when privacy_tier > 1 then 20 else 0 end + case when stability_class in ('identity', 'relationship') then 10 else 0 end + round((1 - cast(coalesce(confidence, 0) as decimal(10, 6))) * 10, 2) as double) as priority
from beliefs b left join e on e.id = b.id left join g on g.id = b.id""")
def review_priorities(spark, d):
    b = load(spark, d, "beliefs")
    k = ["subject_normalized", "predicate", "group_object_key", "valid_from"]
    x, y = b.select("id", *k, "object_text"), b.select(F.col("id").alias("b"), *k, F.col("object_text").alias("other"))
    links = x.join(y, k).where((F.col("object_text") != F.col("other")) & (F.col("id") < F.col("b"))).select(F.col("id").alias("a"), "b")
    return V.review_queue(b, links, load(spark, d, "claims").where("confidence < 0.1"))


@query(f"""
select c.id, count(*) as evidence, min("at") as first_us, max("at") as last_us,
  first(case when length(content_text) > 160 then regexp_replace(substr(content_text, 1, 160), '[\\s\\x0b\\x{{85}}\\x{{a0}}]+$', '') || '…' else content_text end order by "at", m.id) as excerpt
from (select id, unnest(list_distinct(evidence_message_ids)) as e from claims) c join (select id, content_text, {_US_SQL} as at from messages) m on m.id = c.e group by c.id""")
def claim_displays(spark, d):
    return V.target_display(load(spark, d, "claims"), load(spark, d, "messages"))


@query("""
select 'tag' as kind, t as value, count(*) as n from (select unnest(claim_ids) as t from beliefs) group by t
union all select 'state', coalesce(status, 'undecided'), count(*) from beliefs group by 2""")
def tag_counts(spark, d):
    return V.tag_counts(load(spark, d, "beliefs"), "claim_ids", "status")


@query(f"""with {_CONSOLIDATED_SQL} select {_KEYS_SQL}, value, 'insert' as step, valid_from as at from d
union all select {_KEYS_SQL}, value, 'close', valid_to from d where valid_to is not null""")
def belief_transitions(spark, d):
    return V.transitions(C.consolidate(_evidence_claims(spark, d)))


@query("""
select segment_id, coalesce(versions, '<none>') as versions from (select id as segment_id from segments) s
left join (select segment_id as s, first(stability_class order by extracted_at desc, id desc) as latest, array_to_string(list_sort(list_distinct(list(stability_class))), ',') as versions from claims group by 1) on s = segment_id
where latest is distinct from 'identity'""")
def segments_behind_version(spark, d):
    x = load(spark, d, "claims").select("segment_id", F.col("stability_class").alias("version"), F.col("extracted_at").alias("created_at"), "id")
    return V.behind_version(load(spark, d, "segments").select(F.col("id").alias("segment_id")), x, "identity")


@query("""
with a as (select * from claims where privacy_tier <= 1), b as (select * from claims where confidence >= 0.5),
j as (select a.s as x, b.s as y, na, nb from (select segment_id as s, count(*) as na from a group by 1) a full join (select segment_id as s, count(*) as nb from b group by 1) b on a.s = b.s),
p as (select predicate, count(*) / sum(count(*)) over () as p from a group by 1), q as (select predicate, count(*) / sum(count(*)) over () as p from b group by 1)
select count(*) filter (where x is not null and y is not null) as shared, count(*) filter (where y is null) as only_control, count(*) filter (where x is null) as only_candidate,
  cast(sum(na) as bigint) as control_rows, cast(sum(nb) as bigint) as candidate_rows, (select round(sum(abs(coalesce(p.p, 0) - coalesce(q.p, 0))), 9) from p full join q on p.predicate = q.predicate) as l1 from j""")
def run_comparison(spark, d):
    c = load(spark, d, "claims")
    return V.compare_runs(c.where("privacy_tier <= 1"), c.where("confidence >= 0.5"), "segment_id", "predicate")


# ---- snapshots and progress ----


@query("""
with o as (select external_id as k, first(content_sha256 order by recorded_at, item_id) as h from corpus_rows where recorded_at < timestamp '2025-01-01' group by 1),
n as (select external_id as k, first(content_sha256 order by recorded_at desc, item_id desc) as h from corpus_rows where recorded_at >= timestamp '2024-06-01' group by 1)
select coalesce(o.k, n.k) as external_id, case when o.k is null then 'insert' when n.k is null then 'tombstone' when o.h is not distinct from n.h then 'noop' else 'supersede' end as action, o.h as old_hash, n.h as new_hash
from o full join n on o.k = n.k""")
def snapshot_diff(spark, d):
    c = load(spark, d, "corpus_rows")
    when = F.struct("recorded_at", "item_id")
    o = c.where("recorded_at < timestamp'2025-01-01'").groupBy("external_id").agg(F.min_by("content_sha256", when).alias("h"))
    n = c.where("recorded_at >= timestamp'2024-06-01'").groupBy("external_id").agg(F.max_by("content_sha256", when).alias("h"))
    return R.snapshot_diff(o, n, "external_id", "h")


@query("select c.conversation_id as conversation_id, max(c.extracted_at) as newest, any_value(m.mark) as mark from claims c left join (select id, created_at as mark from conversations) m on m.id = c.conversation_id group by 1 having any_value(m.mark) is null or max(c.extracted_at) > any_value(m.mark)")
def above_watermark(spark, d):
    marks = load(spark, d, "conversations").select(F.col("id").alias("conversation_id"), F.col("created_at").alias("mark"))
    return R.above_watermark(load(spark, d, "claims"), marks, "conversation_id", "extracted_at")


@query("select source_id, external_id, count(distinct sha256(coalesce(title, ''))) as hashes from conversations group by source_id, external_id having count(distinct sha256(coalesce(title, ''))) > 1")
def conversation_conflicts(spark, d):
    c = load(spark, d, "conversations").withColumn("h", F.sha2(F.coalesce("title", F.lit("")), 256))
    return R.conflicts(c.limit(0), c, ["source_id", "external_id"], "h")


@query("select conversation_id, count(*) as messages from (select distinct source_id, lower(trim(external_id)) as k, conversation_id from messages where external_id is not null) group by conversation_id")
def distinct_messages_per_conversation(spark, d):
    m = load(spark, d, "messages").where("external_id is not null").select("source_id", F.lower(F.trim("external_id")).alias("k"), "conversation_id").distinct()
    return m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))


# ---- event windows (extensions) ----


@query("select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_events(spark, d):
    e = load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "total")


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as f from events),
s as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as started, count(*) as n from s group by user_id, s""")
def session_events(spark, d):
    e = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", "started", "n")


@query("select a.event_id, max(b.event_id) as last_click from events a left join events b on b.user_id = a.user_id and b.event_type = 'click' and (b.ts < a.ts or (b.ts = a.ts and b.event_id < a.event_id)) where a.event_type = 'purchase' group by a.event_id")
def as_of_last_click(spark, d):
    e = load(spark, d, "events").where("event_type in ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    clicks = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w)
    return e.withColumn("last_click", clicks).where("event_type = 'purchase'").select("event_id", "last_click")
