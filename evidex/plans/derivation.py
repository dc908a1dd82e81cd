"""Queries of derivation: generations, invalidation, payloads, statuses, integrity of references."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import functions as F

from evidex.operators import claims as C
from evidex.operators import derive as D
from evidex.operators import review as V
from evidex.operators import sampling as P
from evidex.plans.catalog import query
from evidex.session import load


@query("""
with g as (select conversation_id, generation_id, count(*) as n from segments group by 1, 2),
bad as (select distinct generation_id from segments s where not exists (select 1 from claims c where c.segment_id = s.id))
select conversation_id, generation_id from g where generation_id not in (select generation_id from bad where generation_id is not null) qualify row_number() over (partition by conversation_id order by n desc, generation_id desc) = 1""")
def activated_generations(spark, d):
    s = load(spark, d, "segments")
    g = s.groupBy("conversation_id", "generation_id").agg(F.count(F.lit(1)).alias("created_at"))
    return D.active_generations(g, s.select("generation_id", F.col("id").alias("segment_id")), load(spark, d, "claims").select("segment_id").distinct())


@query("""
select distinct s.id from (select id, unnest(message_ids) as m from segments) s join messages on messages.id = m where messages.privacy_tier >= 3
union select s.id from segments s join conversations c on c.id = s.conversation_id where c.privacy_tier >= 3""")
def invalidated_segments(spark, d):
    m, c = (load(spark, d, t).where("privacy_tier >= 3") for t in ("messages", "conversations"))
    return D.invalidated(load(spark, d, "segments"), m, c)


@query("""
select id, case when id like '%0' or id like '%1' or id like '%2' or trim(coalesce(content_text, '')) = '' then null else 1 end as parsed from segments""")
def parsed_segment_payloads(spark, d):
    """Payloads of one segment each; some have a key too many, no segment, or a blank text."""
    s = load(spark, d, "segments")
    text = F.when(F.col("id").endswith("2"), F.lit(" ")).otherwise(F.coalesce("content_text", F.lit("")))
    item = F.struct(F.lit("t").alias("title"), F.lit("s").alias("summary"), "message_ids", text.alias("content_text"))
    whole = F.when(F.col("id").endswith("0"), F.to_json(F.struct(F.array(item).alias("segments"), F.lit(1).alias("more")))).when(F.col("id").endswith("1"), F.lit('{"segments": []}')).otherwise(F.to_json(F.struct(F.array(item).alias("segments"))))
    return s.select("id", F.nullif(F.size(D.parsed_segments(whole)), F.lit(-1)).alias("parsed"))


@query("select source_id, batch_id as run_id, messages_seen from ingest_results where messages_seen is not null qualify row_number() over (partition by source_id order by messages_seen desc, batch_id) = 1")
def best_batches(spark, d):
    return D.best_run(load(spark, d, "ingest_results").select("source_id", F.col("batch_id").alias("run_id"), "messages_seen"), "messages_seen", ["source_id"])


@query("""
select tenant_id, corpus_id, case when len(ids) = 0 then 'unknown' when len(ids) = 1 then ids[1] else sha256(array_to_string(ids, chr(0))) end as bundle
from (select tenant_id, corpus_id, coalesce(list_sort(list_distinct(list(export_timezone))), []) as ids from corpus_rows group by 1, 2)""")
def corpus_bundles(spark, d):
    return D.bundle_ids(load(spark, d, "corpus_rows").withColumn("bundle_id", F.col("export_timezone")), ["tenant_id", "corpus_id"])


@query("""
select c.segment_id as id, case when s.id is null then 'unknown parent' else 'other boundary' end as defect from claims c left join (select id, conversation_id, privacy_tier from segments where is_active) s on s.id = c.segment_id
where s.id is null or s.conversation_id is distinct from c.conversation_id or s.privacy_tier is distinct from c.privacy_tier""")
def reference_defects(spark, d):
    r = load(spark, d, "claims").select(F.col("segment_id").alias("id"), "conversation_id", "privacy_tier")
    return D.reference_defects(r, load(spark, d, "segments").where("is_active"), "id", ["conversation_id", "privacy_tier"])


@query("""
select c.id, case when s.id is null then 'unknown parent' when s.conversation_id is distinct from c.conversation_id then 'conversation_id' else 'privacy_tier' end as reason from claims c left join segments s on s.id = c.segment_id
where s.id is null or s.conversation_id is distinct from c.conversation_id or s.privacy_tier is distinct from c.privacy_tier""")
def claim_parent_mismatches(spark, d):
    return P.parent_mismatches(load(spark, d, "claims"), load(spark, d, "segments"), "segment_id", "id", ["conversation_id", "privacy_tier"])


@query(r"""
select id, case when regexp_matches(object_json, '(?i)"(?:content|content_text|body|text|excerpt|snippet|raw|payload)"\s*:') then 'content key' else 'unknown reason' end as defect from claims
where coalesce(regexp_matches(object_json, '(?i)"(?:content|content_text|body|text|excerpt|snippet|raw|payload)"\s*:'), false) or predicate not in ('has_pet', 'lives_at', 'met_with')""")
def audit_defects(spark, d):
    a = load(spark, d, "claims").select("id", F.col("object_json").alias("payload"), F.array("predicate").alias("omitted"))
    return V.audit_defects(a, ["has_pet", "lives_at", "met_with"])


_KINDS_SQL = "(values " + ", ".join(f"('{p}', '{s}', '{k}')" for p, s, _, k, _, _ in C.VOCABULARY) + ") v(p, st, kind)"


@query(f"""
select id, coalesce(st, stability_class) as stability_class, case when kind = 'json' then null else t end as object_text, case when kind = 'text' then null else j end as object_json
from (select id, predicate, stability_class, coalesce(object_text, 'a text') as t, coalesce(object_json, '{{}}') as j from claims) c left join {_KINDS_SQL} on p = predicate""")
def normalized_drafts(spark, d):
    """Drafts with both objects: the one of the wrong kind is dropped."""
    c = load(spark, d, "claims").select("id", "predicate", "stability_class", F.coalesce("object_text", F.lit("a text")).alias("object_text"), F.coalesce("object_json", F.lit("{}")).alias("object_json"))
    return C.normalize_drafts(c).select("id", "stability_class", "object_text", "object_json")


@query("""
select segment_id, extraction_id, case when row_number() over (partition by segment_id order by created_at desc, extraction_id desc) = 1 then 'extracted' else 'superseded' end as status
from (select segment_id, extraction_id, max(extracted_at) as created_at from claims group by 1, 2)""")
def latest_extraction_status(spark, d):
    x = load(spark, d, "claims").groupBy("segment_id", "extraction_id").agg(F.max("extracted_at").alias("created_at")).withColumn("status", F.lit("extracted"))
    return P.only_latest(x, ["segment_id"], ["created_at", "extraction_id"], "status", "extracted", "superseded").select("segment_id", "extraction_id", "status")


@query("select id from beliefs where status = 'candidate' and recorded_at < timestamp '2025-06-01' - to_days(30)")
def stale_candidates(spark, d):
    return P.stale(load(spark, d, "beliefs"), "status", "candidate", "recorded_at", datetime(2025, 6, 1), 30 * 86400).select("id")


@query("select item_id, tenant_id, corpus_id, external_id from corpus_rows where item_id = (select min(item_id) from corpus_rows)")
def fetched_reference(spark, d):
    """The row of an opaque id, fetched again under the rights to its own corpus."""
    c = load(spark, d, "corpus_rows")
    r = c.orderBy("item_id").select("corpus_id", "item_id", "tenant_id").first()
    if r is None:
        return c.select("item_id", "tenant_id", "corpus_id", "external_id")
    reference = base64.urlsafe_b64encode(json.dumps(r.asDict(), sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")
    return V.fetch(c, reference, [(r["tenant_id"], r["corpus_id"])]).select("item_id", "tenant_id", "corpus_id", "external_id")
