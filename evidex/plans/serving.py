"""More queries of the reference's own operators: answers and caps, comparisons, metrics, payloads, exact references, packets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import claims as C
from evidex.operators import evaluate as E
from evidex.operators import relational as R
from evidex.operators import retrieval as S
from evidex.operators import sampling as P
from evidex.operators import segments as SG
from evidex.plans import catalog
from evidex.plans.catalog import _ORDERED_SQL, _score_sql, _sized, query
from evidex.session import load, scratch_path
from evidex.sources import sinks as K

_TARGET = ["subject_normalized", "predicate"]
_LAST_SQL = "(select subject_normalized, predicate, max(recorded_at) as last_at from beliefs where status is distinct from 'superseded' group by 1, 2)"
_DAYS = {"goal": 14, "task": 7, "mood": 3, "preference": 30, "relationship": 60, "identity": 90, "project_status": 30}
_AS_OF = datetime(2026, 1, 1)

# ---- answers, cooldowns, caps, coverage ----


@query(f"select * from {_LAST_SQL}")
def last_answers(spark, d):
    return P.last_answers(load(spark, d, "beliefs"), _TARGET, "recorded_at", "status", "superseded")


@query(f"""
select c.id from claims c left join {_LAST_SQL} l on l.subject_normalized is not distinct from c.subject_normalized and l.predicate is not distinct from c.predicate
where last_at is null or last_at <= timestamp '2026-01-01' - to_days(case stability_class {' '.join(f"when '{k}' then {n}" for k, n in _DAYS.items())} else 14 end)""")
def claims_after_cooldown(spark, d):
    last = P.last_answers(load(spark, d, "beliefs"), _TARGET, "recorded_at", "status", "superseded")
    c = load(spark, d, "claims").select("id", *_TARGET, "stability_class")
    return P.after_cooldown(c, last, _TARGET, "stability_class", _DAYS, 14, _AS_OF).select("id")


@query("""
select id from claims c where not exists (select 1 from (select subject_normalized as s, predicate as p from beliefs group by 1, 2 having count(*) >= 3)
  where s is not distinct from c.subject_normalized and p is not distinct from c.predicate)""")
def claims_below_cap(spark, d):
    return P.below_cap(load(spark, d, "claims").select("id", *_TARGET), load(spark, d, "beliefs"), _TARGET, 3).select("id")


_PROGRESS_SQL = """select {0}, count(*) as targets, count(hit) as answered, count(*) - count(hit) as open from (select distinct {0}, subject_normalized, predicate from claims) t
left join (select distinct subject_normalized as s, predicate as p, 1 as hit from beliefs) on s is not distinct from t.subject_normalized and p is not distinct from t.predicate group by {0}"""


@query(_PROGRESS_SQL.format("conversation_id"))
def session_progress(spark, d):
    return P.progress(load(spark, d, "claims"), load(spark, d, "beliefs"), "conversation_id", _TARGET)


@query(f"select stability_class, targets, answered as labelled, round(answered / targets, 6) as rate from ({_PROGRESS_SQL.format('stability_class')})")
def label_coverage(spark, d):
    return P.coverage(load(spark, d, "claims"), load(spark, d, "beliefs"), "stability_class", _TARGET)


@query("""
select segment_id, id, predicate, subject_text, row_number() over (partition by segment_id order by predicate, subject_text nulls first, id) as position from claims qualify position <= 80""")
def segment_claim_details(spark, d):
    c = load(spark, d, "claims").select("segment_id", "id", "predicate", "subject_text")
    return P.first_rows(c, "segment_id", ["predicate", "subject_text", "id"], 80)


@query("select id, source_kind from segments where is_active and source_kind = 'claude'")
def optional_filter(spark, d):
    return P.optional(load(spark, d, "segments").where("is_active"), source_kind="claude", conversation_id=None).select("id", "source_kind")


@query("""
select s.id, case when len(message_ids) <= 2 and coalesce(length(content_text), 0) < 2000 then 'short' when len(message_ids) <= 8 and coalesce(length(content_text), 0) < 8000 then 'medium' else 'long' end as bucket from segments s""")
def segment_size_buckets(spark, d):
    return load(spark, d, "segments").select("id", P.size_bucket(F.size("message_ids"), F.coalesce(F.length("content_text"), F.lit(0))).alias("bucket"))


@query("select source_kind, count(*) as available, least(count(*), 200) as picked, greatest(200 - count(*), 0) as shortfall from segments where is_active group by source_kind")
def sample_shortfalls(spark, d):
    return P.shortfalls(load(spark, d, "segments").where("is_active"), "source_kind", 200)


# ---- metrics and comparisons ----


@query("""
select event_type, count(value) as n, round(min(value), 6) as min, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as max from events group by event_type""")
def latency_summary(spark, d):
    return P.latency_summary(load(spark, d, "events"), "value", ["event_type"])


@query(f"""
with k as ({catalog._SQL['claim_defects']}), s as (select count(*) as t, count(c) as n from segments left join (select distinct segment_id as c from claims) on c = id)
select t as segments_total, n as segments_completed, (select count(*) - count(reason) from k) as claim_count, (select count(reason) from k) as dropped_claim_count,
  round(n / t, 6) as segment_completion_rate, round((select count(reason) / count(*) from k), 6) as dropped_claim_rate from s""")
def run_metrics(spark, d):
    c, s = load(spark, d, "claims"), load(spark, d, "segments")
    return P.run_metrics(s, c, C.validate(c, s))


_COMPARED_SQL = """
with p as (select segment_id as s, count(*) as pn, list_sort(list_distinct(list(predicate))) as pk, sum(len(evidence_message_ids)) as pe from claims where extracted_at < timestamp '2025-01-01' group by 1),
c as (select segment_id as s, count(*) as cn, list_sort(list_distinct(list(predicate))) as ck, sum(len(evidence_message_ids)) as ce from claims where extracted_at >= timestamp '2024-06-01' group by 1),
j as (select coalesce(p.s, c.s) as segment_id, pn, coalesce(cn, 0) as cn, coalesce(pk, []) as pk, coalesce(ck, []) as ck, pe, ce from p full join c on p.s = c.s),
t as (select segment_id, case when pn is null then 'prior_missing' when cn = 0 then 'candidate_zero' else 'complete' end as state,
  list_filter([case when pn > 0 and cn = 0 then 'zeroed' end, case when cn > 0 and (ce is null or ce = 0 or ce < pe) then 'provenance_anomaly' end, case when pn <> cn then 'count_changed' end,
    case when pk <> ck then 'predicate_mix_changed' end, case when pn = 0 and cn > 0 then 'newly_nonzero' end], lambda x: x is not null) as tags from j),
u as (select segment_id, state, case when len(tags) = 0 then ['unchanged'] else tags end as tags from t),
r as (select segment_id, state, array_to_string(tags, ',') as tags, cast(case state when 'candidate_zero' then 0 when 'complete' then 1 else 5 end as integer) as state_rank,
  cast(case tags[1] when 'zeroed' then 0 when 'high_drop_count' then 1 when 'provenance_anomaly' then 2 when 'count_changed' then 3 when 'predicate_mix_changed' then 4 when 'newly_nonzero' then 5 else 6 end as integer) as risk_rank from u)"""


def _compared(spark, d):
    c = load(spark, d, "claims")
    return P.compare_segments(c.where("extracted_at < timestamp'2025-01-01'"), c.where("extracted_at >= timestamp'2024-06-01'"))


@query(f"{_COMPARED_SQL} select * from r")
def segment_comparisons(spark, d):
    return _compared(spark, d).withColumn("tags", F.array_join("tags", ","))


@query(f"{_COMPARED_SQL} select * from r order by state_rank, risk_rank, segment_id limit 100")
def comparison_queue(spark, d):
    return P.queue(_compared(spark, d), 100).withColumn("tags", F.array_join("tags", ","))


# ---- state: progress, updates, views ----


@query("""
select c.id from conversations c where coalesce((select count(*) from messages m where m.conversation_id = c.id and content_text is null), 0) < 3""")
def within_retry_budget(spark, d):
    errors = load(spark, d, "messages").where("content_text is null").groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("error_count"))
    return P.within_retry_budget(load(spark, d, "conversations").select("id"), errors, "id")


@query("""
select distinct c.extraction_id, c.segment_id, case when s.invalidated_at is not null or not s.is_active then 'superseded' else 'extracted' end as status
from claims c left join segments s on s.id = c.segment_id""")
def superseded_extractions(spark, d):
    x = load(spark, d, "claims").select("extraction_id", "segment_id").distinct().withColumn("status", F.lit("extracted"))
    gone = load(spark, d, "segments").where("invalidated_at is not null or not is_active").select("id")
    return P.update_from(x, gone, "segment_id", "id", {"status": F.lit("superseded")})


@query(catalog._SQL["current_beliefs"])
def refreshed_current_beliefs(spark, d):
    return K.refresh(catalog.current_beliefs(spark, d), scratch_path(spark, "current_beliefs"))


_DIGEST_SQL = """select tenant_id, corpus_id, count(*) as items, sha256(count(*)::varchar || '|' || sum(('0x' || substr(h, 1, 12))::bigint)::bigint || '|' || sum(('0x' || substr(h, 13, 12))::bigint)::bigint || '|'
  || sum(('0x' || substr(h, 25, 12))::bigint)::bigint || '|' || sum(('0x' || substr(h, 37, 12))::bigint)::bigint) as digest
from (select *, sha256(concat_ws(chr(0), item_id, coalesce(external_id, ''), coalesce(content_sha256, ''))) as h from corpus_rows {}) group by tenant_id, corpus_id"""
catalog._SQL["corpus_manifest"] = _DIGEST_SQL.format("")


@query(f"""
select n.tenant_id, n.corpus_id from ({_DIGEST_SQL.format('')}) n
where not exists (select 1 from ({_DIGEST_SQL.format("where recorded_at < timestamp '2024-01-01'")}) o where o.tenant_id = n.tenant_id and o.corpus_id = n.corpus_id and o.digest = n.digest)""")
def changed_corpora(spark, d):
    c = load(spark, d, "corpus_rows")
    return S.changed_corpora(S.manifest(c.where("recorded_at < timestamp'2024-01-01'")), S.manifest(c))


_EIGHT = ["tenant_id", "corpus_id", "sub_kind", "export_timezone", "redaction_state", "privacy_tier", "source_kind", "emitted_day"]


@query(f"""
with r as (select *, date_trunc('month', emitted_at) as emitted_day from corpus_rows)
select a.item_id from r a where a.recorded_at >= timestamp '2024-06-01' and exists (select 1 from r b where b.recorded_at < timestamp '2024-06-01'
  and {' and '.join(f'a.{k} is not distinct from b.{k}' for k in _EIGHT)})""")
def answered_by_eight_keys(spark, d):
    c = load(spark, d, "corpus_rows").withColumn("emitted_day", F.date_trunc("month", "emitted_at"))
    old = c.where("recorded_at < timestamp'2024-06-01'").select(*_EIGHT).distinct()
    return R.answered(c.where("recorded_at >= timestamp'2024-06-01'"), old, _EIGHT).select("item_id")


@query("""
select c.id, s.generation_id, v.source_id, m.batch_id, i.export_timezone from claims c join segments s on s.id = c.segment_id join conversations v on v.id = c.conversation_id
join messages m on m.id = c.evidence_message_ids[1] join ingest_results i on i.batch_id = m.batch_id""")
def claim_chain_of_five(spark, d):
    s = load(spark, d, "segments").select(F.col("id").alias("segment_id"), "generation_id")
    v = load(spark, d, "conversations").select(F.col("id").alias("conversation_id"), "source_id")
    m = load(spark, d, "messages").select(F.col("id").alias("e"), "batch_id")
    i = load(spark, d, "ingest_results").select("batch_id", "export_timezone")
    c = load(spark, d, "claims").select("id", "segment_id", "conversation_id", F.get("evidence_message_ids", F.lit(0)).alias("e"))
    return c.join(s, "segment_id").join(v, "conversation_id").join(m, "e").join(i, "batch_id").select("id", "generation_id", "source_id", "batch_id", "export_timezone")


@query("""
with g as (select generation_id, bool_or(is_active) as live from segments group by 1)
select s.id from segments s join g on g.generation_id = s.generation_id where s.is_active and g.live and s.source_kind in ('chatgpt', 'claude', 'gemini') and s.conversation_id is not null""")
def segments_of_active_generations(spark, d):
    s = load(spark, d, "segments")
    g = s.groupBy("generation_id").agg(F.bool_or("is_active").alias("live")).where("live").select("generation_id")
    return s.where("is_active and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null").join(g, "generation_id", "left_semi").select("id")


@query("select c.id, b.id as belief_id from claims c join (select subject_normalized as s, subject_text as t, min(id) as id from beliefs group by 1, 2) b on b.s = c.subject_normalized or lower(b.t) = lower(c.subject_text)")
def subject_matches(spark, d):
    """Subjects of claims met by key or, regardless of case, by name: two equi-joins, each pair once."""
    b = load(spark, d, "beliefs").groupBy(F.col("subject_normalized").alias("s"), F.col("subject_text").alias("t")).agg(F.min("id").alias("belief_id"))
    c = load(spark, d, "claims").select("id", "subject_normalized", "subject_text")
    by_key = c.join(b, c["subject_normalized"] == b["s"])
    by_name = c.join(b, F.lower(c["subject_text"]) == F.lower(b["t"])).where(~F.coalesce(F.col("subject_normalized") == F.col("s"), F.lit(False)))
    return by_key.select("id", "belief_id").unionByName(by_name.select("id", "belief_id"))


# ---- payloads and parts ----


def _payloads(spark, d):
    item = F.struct(
        "subject_text", "predicate", "object_text", F.from_json("object_json", "map<string,string>").alias("object_json"), "stability_class",
        F.when(F.col("id").endswith("0"), F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"), "evidence_message_ids", F.lit("because").alias("rationale"),
    )
    one = F.when(F.col("id").endswith("f"), F.to_json(F.struct("subject_text", "predicate"))).otherwise(F.to_json(item, {"ignoreNullFields": "false"}))
    c = load(spark, d, "claims").select("segment_id", "id", one.alias("one"))
    whole = F.concat(F.lit('{"claims": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "one"))), lambda x: x["one"]), ", "), F.lit("]}"))
    return c.groupBy(F.col("segment_id").alias("key")).agg(whole.alias("payload"))  # a segment's claims are few


@query(f"""
with c as (select *, row_number() over (partition by segment_id order by id) - 1 as n, case when id like '%0' then confidence + 1 else confidence end as conf from claims),
x as (select segment_id, n, case when id like '%f' then 'does not match the schema' when subject_text is null or trim(subject_text) = '' then 'has empty subject_text'
  when predicate is null or predicate not in ({", ".join(f"'{p}'" for p, *_ in C.VOCABULARY)}) then 'has invalid predicate' when trim(object_text) = '' then 'has empty object_text'
  when stability_class is null or stability_class not in ({", ".join(f"'{k}'" for k in C.STABILITY)}) then 'has invalid stability_class' when conf is null or conf < 0 or conf > 1 then 'has invalid confidence'
  when coalesce(len(evidence_message_ids), 0) = 0 then 'has invalid evidence_message_ids' end as defect from c)
select segment_id as key, first('claim ' || n || ' ' || defect order by n) filter (where defect is not null) as defect from x group by segment_id""")
def payload_defects(spark, d):
    return C.payload_defects(_payloads(spark, d))


@query("""
with m as (select s.id as key, list(e order by pos) as items from (select id, unnest(message_ids) as e, generate_subscripts(message_ids, 1) as pos from segments) s group by 1),
p as (select key, items, len(items) as n, greatest(1, len(items) // 2) as cut, content_text as t, length(coalesce(content_text, '')) as k from m join segments on id = key)
select key, 0 as half, array_to_string(case when n > 1 then items[1:cut] else items end, ',') as items, case when n = 1 then t[1:k // 2] end as text from p where n > 1 or (n = 1 and k >= 2)
union all select key, 1, array_to_string(case when n > 1 then items[cut + 1:] else items end, ','), case when n = 1 then t[k // 2 + 1:] end from p where n > 1 or (n = 1 and k >= 2)""")
def segment_halves(spark, d):
    parts = load(spark, d, "segments").select(F.col("id").alias("key"), F.col("message_ids").alias("items"), F.col("content_text").alias("text"))
    return C.halves(parts).withColumn("items", F.array_join("items", ","))


def _chunks_sql(most: int, chars: int) -> str:
    new = f"r.c >= {most} or r.open + m.n > {chars}"
    return f"""
with recursive m as (select s.id as segment_id, pos - 1 as at_, coalesce(length(m.content_text), 0) as n, row_number() over (partition by s.id order by pos) as k
  from (select id, unnest(message_ids) as e, generate_subscripts(message_ids, 1) as pos from segments) s join messages m on m.id = s.e),
r as (select segment_id, at_, k, 1 as c, n as open, 0 as chunk from m where k = 1
  union all select m.segment_id, m.at_, m.k, case when {new} then 1 else r.c + 1 end, case when {new} then m.n else r.open + m.n end, r.chunk + case when {new} then 1 else 0 end from r join m on m.segment_id = r.segment_id and m.k = r.k + 1)"""


catalog._SQL["extraction_chunks"] = f'{_chunks_sql(4, 500)} select segment_id, cast(at_ as integer) as "at", chunk from r'


def _chunks(spark, d):
    m = load(spark, d, "messages").select(F.col("id").alias("e"), F.coalesce(F.length("content_text"), F.lit(0)).cast("long").alias("n_chars"))
    s = load(spark, d, "segments").select(F.col("id").alias("segment_id"), F.posexplode("message_ids").alias("at", "e"))
    rows = s.join(m, "e")
    return rows, C.chunks(rows.select("segment_id", "at", "n_chars"))


@query(f'{_chunks_sql(12, 6000)} select segment_id, cast(at_ as integer) as "at", chunk from r')
def extraction_parts(spark, d):
    return _chunks(spark, d)[1]


@query(f"""{_chunks_sql(12, 6000)},
w as (select r.segment_id, r.chunk, s.e from r join (select id, unnest(message_ids) as e, generate_subscripts(message_ids, 1) as pos from segments) s on s.id = r.segment_id and s.pos = r.at_ + 1)
select c.id, count(distinct w.chunk) as chunks, count(*) filter (where w.e is null) as outside, count(distinct w.chunk) <> 1 or count(*) filter (where w.e is null) > 0 as dropped
from (select id, segment_id, unnest(list_distinct(evidence_message_ids)) as e from claims) c left join w on w.segment_id = c.segment_id and w.e = c.e group by c.id""")
def claims_outside_chunk(spark, d):
    rows, chunks = _chunks(spark, d)
    w = rows.select("segment_id", "at", "e").join(chunks, ["segment_id", "at"]).select("segment_id", "e", "chunk")
    c = load(spark, d, "claims").select("id", "segment_id", F.explode(F.array_distinct("evidence_message_ids")).alias("e"))
    g = c.join(w, ["segment_id", "e"], "left").groupBy("id").agg(F.count_distinct("chunk").alias("chunks"), (F.count(F.lit(1)) - F.count("chunk")).alias("outside"))
    return g.withColumn("dropped", (F.col("chunks") != 1) | (F.col("outside") > 0))


# ---- exact references, labels, packets ----

_HAY_SQL = """lower(concat_ws(' ', coalesce(content, ''), external_id, coalesce(sub_kind, ''), case when provenance is null then '{}' else '{"commit_sha": ' || coalesce('"' || provenance.commit_sha || '"', 'null') || ', "path": ' || coalesce('"' || provenance.path || '"', 'null') || '}' end))"""
_REF_TERMS = "belief history"


@query(f"""
with named as (select *, row_number() over (partition by tenant_id, corpus_id order by recorded_at desc, external_id, item_id) as age from corpus_rows
  where lower(trim(provenance.path)) = 'docs/commit/0000.md' or lower(trim(provenance.commit_sha)) = '42f87fa9bc'),
lanes as (
  select tenant_id, corpus_id, item_id, external_id, 'references' as lane, cast(round(10 + {_score_sql(_HAY_SQL, _REF_TERMS)}, 4) as double) as score from named where age <= 1000
  union all select tenant_id, corpus_id, item_id, external_id, 'commit_sha', 100 from corpus_rows where lower(provenance.commit_sha) = '42f87fa9bc'
  union all select tenant_id, corpus_id, item_id, external_id, 'path', 100 from corpus_rows where lower(provenance.path) = 'docs/commit/0000.md'
  union all select tenant_id, corpus_id, item_id, external_id, 'source_hash', 100 from corpus_rows where content_sha256 = (select min(content_sha256) from corpus_rows))
select *, row_number() over (partition by tenant_id, corpus_id order by cast(trunc(score) as integer) desc, coalesce(external_id, ''), lane, item_id) as rank from lanes qualify rank <= 10""")
def exact_reference_hits(spark, d):
    c = load(spark, d, "corpus_rows")
    named = spark.createDataFrame([("path", "Docs\\commit\\0000.md"), ("commit_sha", "42F87FA9BC")], "ref_kind string, ref_value string")
    source = c.agg(F.min("content_sha256").alias("ref_value")).select(F.lit("source_hash").alias("ref_kind"), "ref_value")
    return S.exact_hits(c, named.unionByName(source), _REF_TERMS)


_OPAQUE_SQL = """rtrim(replace(replace(base64(encode('{"corpus_id":"' || corpus_id || '","item_id":"' || item_id || '","tenant_id":"' || tenant_id || '"}')), '+', '-'), '/', '_'), '=')"""
catalog._SQL["opaque_references"] = f"select item_id, {_OPAQUE_SQL} as reference, true as round_trip from corpus_rows"
_LABELLED_SQL = f"""(
with r as (select *, lower(concat_ws(' ', coalesce(content, ''), coalesce(external_id, ''), coalesce(sub_kind, ''), coalesce(provenance.path, ''), coalesce(provenance.commit_sha, ''))) as hay
  from corpus_rows qualify row_number() over (partition by tenant_id, corpus_id order by recorded_at desc, external_id, item_id) <= 1000),
s as (select *, cast({_score_sql('hay', 'the belief history')} as double) as score from r),
h as (select *, row_number() over (partition by tenant_id, corpus_id order by score desc, external_id, item_id) as hit from s where score > 0 qualify hit <= 50)
select {_OPAQUE_SQL} as reference_id, tenant_id, corpus_id, source_kind, coalesce(sub_kind, 'unknown') as sub_kind, external_id, coalesce(content, '') as content, score, privacy_tier,
  case when provenance is null then '{{}}' else '{{"commit_sha": ' || coalesce('"' || provenance.commit_sha || '"', 'null') || ', "path": ' || coalesce('"' || provenance.path || '"', 'null') || '}}' end as provenance,
  coalesce(redaction_state = 'dirty', false) as dirty_working_tree, case when redaction_state = 'dirty' then 'dirty_working_tree' when redaction_state is not null then 'fresh' else 'unknown' end as freshness from h)"""


def _labelled(spark, d):
    return S.labelled(S.search_each(load(spark, d, "corpus_rows"), "the belief history", 50).withColumn("score", F.col("score").cast("double")))


@query(f"select * from {_LABELLED_SQL}")
def labelled_hits(spark, d):
    return _labelled(spark, d)


_EXTRA_SQL = "(len(string_split(trim(regexp_replace('\"' || coalesce({}, '') || '\"', '\\s+', ' ', 'g')), ' ')) - 1)"
_COST_SQL = "cast(greatest(1, len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' '))) + 28 + " + " + ".join(_EXTRA_SQL.format(c) for c in ["json_extract_string(provenance, '$.path')", *S._CITED]) + " as integer)"


@query(f"""
with recursive l as (select *, row_number() over (partition by tenant_id, corpus_id order by score desc, external_id, reference_id) as rank, {_COST_SQL} as cost from {_LABELLED_SQL}),
r as (select tenant_id, corpus_id, rank, reference_id, cost, case when cost > 400 then 'over_budget' else '' end as reason, case when cost > 400 then 0 else cost end as used, case when cost > 400 then [] else [reference_id] end as seen from l where rank = 1
  union all select l.tenant_id, l.corpus_id, l.rank, l.reference_id, l.cost, x.reason, r.used + case when x.reason = '' then l.cost else 0 end, case when x.reason = '' then list_append(r.seen, l.reference_id) else r.seen end
  from r join l on l.tenant_id = r.tenant_id and l.corpus_id = r.corpus_id and l.rank = r.rank + 1, lateral (select case when list_contains(r.seen, l.reference_id) then 'duplicate' when r.used + l.cost > 400 then 'over_budget' else '' end as reason) x)
select tenant_id, corpus_id, 'candidate-' || lpad(rank::varchar, 4, '0') as candidate_id, reference_id, cast(rank as integer) as rank, cost, reason = '' as selected, reason from r""")
def packet_items(spark, d):
    return S.build_packets(_labelled(spark, d), 400)


# ---- segmentation quality ----


_BOUNDS_SQL = f"""
with f as ({{fixed}}), g as ({{groups}}),
p as (select conversation_id, list_sort(list(b)) as p from (select conversation_id, min(sequence_index) as b from f where segment > 0 group by conversation_id, segment) group by 1),
e as (select conversation_id, list_sort(list(b)) as e from (select conversation_id, min(sequence_index) as b from g where segment > 0 group by conversation_id, segment) group by 1),
x as (select a.conversation_id, max(sequence_index) + 1 as n, any_value(coalesce(e, [])) as e, any_value(coalesce(p, [])) as p from f a left join e on e.conversation_id = a.conversation_id left join p on p.conversation_id = a.conversation_id group by 1),
m as (select *, len(list_intersect(e, p)) as tp, greatest(1, least(n - 1, cast(round_even(n / (len(e) + 1) / 2, 0) as integer))) as k from x)""".format(fixed=catalog._SQL["fixed_token_segments"], groups=catalog._SQL["message_group_segments"])
_COUNT_IN = "len(list_filter({}, lambda b: b > s and b <= s + k))"


@query(f"""{_BOUNDS_SQL},
r as (select *, case when len(e) = 0 and len(p) = 0 then 1.0 when len(p) = 0 then 0.0 else tp / len(p) end as precision, case when len(e) = 0 and len(p) = 0 then 1.0 when len(e) = 0 then 0.0 else tp / len(e) end as recall,
  case when n < 2 or n <= k then 0.0 else len(list_filter(range(cast(n - k as bigint)), lambda s: ({_COUNT_IN.format('e')} = 0) <> ({_COUNT_IN.format('p')} = 0))) / (n - k) end as pk,
  case when n < 2 or n <= k then 0.0 else len(list_filter(range(cast(n - k as bigint)), lambda s: {_COUNT_IN.format('e')} <> {_COUNT_IN.format('p')})) / (n - k) end as wd from m)
select count(*) as parents, round(avg(round(precision, 6)), 6) as precision, round(avg(round(recall, 6)), 6) as recall, round(avg(round(case when len(e) = 0 and len(p) = 0 then 1.0 when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end, 6)), 6) as f1,
  round(avg(round(pk, 6)), 6) as pk, round(avg(round(wd, 6)), 6) as windowdiff from r""")
def macro_boundary_scores(spark, d):
    return E.macro_scores(catalog.boundary_scores(spark, d))


_PROMPT_SQL = catalog._PROMPT_SQL


@query(catalog._greedy_sql(f"select conversation_id as k, sequence_index as pos, least(60000, {_PROMPT_SQL}) as size from {_ORDERED_SQL}", 60000, '"window", k as conversation_id, pos as sequence_index, truncated', f'join (select conversation_id as k, sequence_index as pos, {_PROMPT_SQL} > 60000 as truncated from {_ORDERED_SQL}) using (k, pos)').replace('select "window"', 'select segment as "window"'))
def windows_default_budget(spark, d):
    return SG.windows_by_budget(catalog._ordered(spark, d))


@query(f"""
with w as ({catalog._SQL['windows_by_budget']}), f as (select conversation_id, "window" from w group by 1, 2 having count(*) > 8)
select w.conversation_id, sequence_index, w."window", case when f."window" is not null then sequence_index end as part from w left join f on f.conversation_id = w.conversation_id and f."window" = w."window\"""")
def split_failed_windows(spark, d):
    """Windows of more than eight messages count as failed."""
    w = SG.windows_by_budget(catalog._ordered(spark, d), 4000).drop("truncated")
    return SG.split_windows(w, w.groupBy("conversation_id", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 8"))


@query("select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(content_text, ''), '(?i)\\b(?:api[_-]?key|secret|token|password|passwd|pwd)\\b\\s*[:=]\\s*\\S+', '[REDACTED]', 'g'), '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]', 'g'), '\\bgh[pousr]_[A-Za-z0-9]{20,}\\b', '[REDACTED]', 'g'), '\\bxox[abprs]-[A-Za-z0-9-]+|\\bglpat-[A-Za-z0-9-]+', '[REDACTED]', 'g') as text from messages".replace("\\\\", "\\"))
def redacted_messages(spark, d):
    return load(spark, d, "messages").select("id", T.redact_secrets(F.coalesce("content_text", F.lit(""))).alias("text"))


catalog._SQL["split_rates"] = f"""{_BOUNDS_SQL}
select round(avg((len(p) > len(e))::int), 6) as over_split_rate, round(avg((len(p) < len(e))::int), 6) as under_split_rate, round(sum(len(p) + 1) / sum(len(e) + 1), 6) as segment_ratio,
  round(coalesce(avg((len(p) > 0)::int) filter (where len(e) = 0), 0), 6) as false_split_rate from m"""
catalog._SQL["evidence_context_windows"] = f"""
select c.id, c.e as evidence_id, m.id as message_id, m.sequence_index - x.sequence_index as offset from (select id, unnest(list_distinct(evidence_message_ids)) as e from claims) c
join messages x on x.id = c.e join {_ORDERED_SQL} m on m.conversation_id = x.conversation_id and m.sequence_index between x.sequence_index - 2 and x.sequence_index + 2"""
catalog._SQL["canonical_objects"] = r"""
select id, sha256('{' || array_to_string(['"' || k || '":' || json_extract(object_json, '$.' || k)::varchar for k in list_sort(json_keys(object_json))], ',') || '}') as digest,
  regexp_matches(object_json, '(?i)"(?:content|content_text|body|text|excerpt|snippet|raw|payload)"\s*:') as has_content from claims where object_json is not null""".replace("\\\\", "\\")
catalog._SQL["derived_references"] = r"""
with t as (select item_id, sub_kind, provenance.path as path, provenance.commit_sha as sha, concat_ws(' ', external_id, content) as x from corpus_rows),
r as (select item_id, 'path' as ref_kind, path as ref_value, lower(replace(trim(path), '\', '/')) as normalized from t union all select item_id, 'commit_sha', sha, lower(trim(sha)) from t union all select item_id, 'item_id', item_id, lower(trim(item_id)) from t
  union all select item_id, 'rfc_id', v, v from (select item_id, 'rfc ' || lpad(nullif(regexp_extract(x, '(?i)(?:^|[^0-9])0*([0-9]{1,5})(?:[^0-9]|$)', 1), ''), 4, '0') as v from t where contains(sub_kind, 'rfc'))
  union all select item_id, 'decision_id', v, v from (select item_id, upper(nullif(regexp_extract(x, '(?i)\b(D[0-9]{2,5})\b', 1), '')) as v from t where contains(sub_kind, 'decision')))
select item_id, ref_kind, normalized, min(ref_value) as ref_value from r where trim(ref_value) <> '' group by 1, 2, 3"""
catalog._SQL["packet"] = f"""
with recursive h as (select *, row_number() over (partition by tenant_id, corpus_id order by score desc, external_id, item_id) as rank from (
  select *, cast({_score_sql('hay', 'the belief history')} as double) as score from (
    select *, lower(concat_ws(' ', coalesce(content, ''), coalesce(external_id, ''), coalesce(sub_kind, ''), coalesce(provenance.path, ''), coalesce(provenance.commit_sha, ''))) as hay
    from corpus_rows qualify row_number() over (partition by tenant_id, corpus_id order by recorded_at desc, external_id, item_id) <= 1000)) where score > 0 qualify rank <= 50),
l as (select tenant_id, corpus_id, item_id, rank, cast(greatest(1, len(string_split(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')), ' '))) + len(string_split(trim(regexp_replace(concat_ws(' ', item_id, external_id), '\\s+', ' ', 'g')), ' ')) as integer) as cost from h),
r as (select tenant_id, corpus_id, item_id, rank, cost, cost <= 300 as included, case when cost <= 300 then cost else 0 end as used from l where rank = 1
  union all select l.tenant_id, l.corpus_id, l.item_id, l.rank, l.cost, r.used + l.cost <= 300, r.used + case when r.used + l.cost <= 300 then l.cost else 0 end from r join l on l.tenant_id = r.tenant_id and l.corpus_id = r.corpus_id and l.rank = r.rank + 1)
select tenant_id, corpus_id, item_id, cast(rank as integer) as rank, cost, included from r"""
catalog._SQL["boundary_scores"] = f"""{_BOUNDS_SQL.replace('with f as', 'with recursive f as', 1)},
t as (select conversation_id, 0 as i, e as free, 0 as hits from m
  union all select t.conversation_id, i + 1, case when hit is null then free else list_filter(free, lambda x: x <> hit) end, hits + (hit is not null)::int
  from t join m on m.conversation_id = t.conversation_id, lateral (select list_filter(t.free, lambda x: abs(x - m.p[t.i + 1]) <= 1)[1] as hit) where i < len(m.p)),
r as (select m.*, case when len(e) = 0 and len(p) = 0 then 1.0 when len(p) = 0 then 0.0 else tp / len(p) end as pr, case when len(e) = 0 and len(p) = 0 then 1.0 when len(e) = 0 then 0.0 else tp / len(e) end as re, t.hits,
  case when n < 2 or n <= k then 0.0 else len(list_filter(range(cast(n - k as bigint)), lambda s: ({_COUNT_IN.format('e')} = 0) <> ({_COUNT_IN.format('p')} = 0))) / (n - k) end as pk,
  case when n < 2 or n <= k then 0.0 else len(list_filter(range(cast(n - k as bigint)), lambda s: {_COUNT_IN.format('e')} <> {_COUNT_IN.format('p')})) / (n - k) end as wd from m join t on t.conversation_id = m.conversation_id and t.i = len(m.p))
select conversation_id, round(pr, 6) as precision, round(re, 6) as recall, round(case when len(e) = 0 and len(p) = 0 then 1.0 when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end, 6) as f1, hits as within_1, round(pk, 6) as pk, round(wd, 6) as windowdiff from r"""
_FRAGMENT_SQL = r"trim(regexp_replace(replace(lower(content_text), 'ß', 'ss'), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+', ' ', 'g'))"
catalog._SQL["fragmentation"] = rf"""
with s as (select conversation_id, sequence_index, {catalog._TOKENS_SQL} as tokens, {_FRAGMENT_SQL} as t from segments where is_active),
n as (select *, lead(tokens) over w as next_tokens, lead(t) over w as u from s window w as (partition by conversation_id order by sequence_index)),
x as (select *, list_distinct(string_split(t, ' ')) as a, list_distinct(string_split(u, ' ')) as b from n)
select count(*) as segments, round(avg((tokens < 50)::int), 6) as sub_50_rate, round(avg((tokens < 100)::int), 6) as sub_100_rate, round(avg((tokens < 200)::int), 6) as sub_200_rate, count(next_tokens) as pairs,
  coalesce(round(avg((tokens < 100 and next_tokens < 100)::int) filter (where next_tokens is not null), 6), 0) as tiny_pair_rate,
  coalesce(round(avg(coalesce(t = u or (t <> '' and u <> '' and len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.9), false)::int) filter (where next_tokens is not null), 6), 0) as duplicate_pair_rate from x"""
_WHITE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
catalog._SQL["embeddable_segments"] = rf"""
with l as (select id, content_text, list_filter(string_split_regex(content_text, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: not regexp_matches(x, '{T.MARKER}')) as lines from segments),
j as (select id, content_text, array_to_string(list_transform(lines, lambda x: regexp_replace(x, '{_WHITE}+$', '')), chr(10)) as t from l)
select id, length(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g')) as chars, length({_FRAGMENT_SQL}) as fragment_chars from j"""
