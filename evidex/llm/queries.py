"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import conversations, langid, mixing, names, neighbours, packing, pii, tokens
from evidex.session import load, spread, stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(pii.texts_of(load(spark, d, "messages"), load(spark, d, "segments")))
    return pii.find(texts, *pii.fitted(texts)).select("record_table", "record_id", "pii_kind", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(pii.texts_of(load(spark, d, "messages"), load(spark, d, "segments")))
    return pii.redact(texts, *pii.fitted(texts))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors, probes = load(spark, d, "embedding_cache"), load(spark, d, "probe_vectors").select("cache_id").distinct()
    return neighbours.neighbours(vectors, vectors.join(probes, "cache_id", "left_semi"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(_neighbours(spark, d))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).withColumn("similarity", F.round("similarity", 6))


def _verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    messages = load(spark, d, "messages")
    feed = stage(conversations.feed_of(messages, deduplicate=True), "kept")
    return messages, conversations.verdicts(messages, load(spark, d, "conversations"), feed=feed), feed


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)[1].where("defect is not null").select("conversation_id", "defect")


def p5_dialogues(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dialogues(*_verdicts(spark, d))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_groups(load(spark, d, "claims").select(F.col("subject_normalized").alias("value")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_groups(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.sizes(spread(load(spark, d, "documents").select("doc_id", "text"))), load(spark, d, "pack_capacities"))


def p8_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.contents(_containers(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_containers(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = stage(tokens.sizes(spread(load(spark, d, "documents").select("doc_id", "source", "text")), keep=("source",)), "sizes")
    return mixing.mix(sizes, load(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_even_shares(spark: SparkSession, d: str) -> DataFrame:
    """p9_shares() with the total shrunk until no source that is there is too small."""
    sizes = stage(tokens.sizes(spread(load(spark, d, "documents").select("doc_id", "source", "text")), keep=("source",)), "sizes")
    targets = load(spark, d, "mix_targets")
    return mixing.mix(sizes, targets, mixing.even_total(sizes, targets))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    found = langid.detect(spread(documents.select("doc_id", "text")), langid.fit(documents))
    return langid.relabelled(documents, found)


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return langid.detect(spread(documents.select("doc_id", "text")), langid.fit(documents)).withColumn("confidence", F.round("confidence", 6))


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_redacted, p3_found, p3_neighbours, p5_found, p5_dialogues, p6_found, p6_groups, p8_contents, p8_fill, p9_mix, p9_shares, p9_even_shares, p10_found, p10_passages,
    )}


_VERDICTS = r"""
kept as (select * from messages qualify external_id is null or source_id is null
  or row_number() over (partition by source_id, lower(regexp_replace(external_id, '^\s+|\s+$', '', 'g')) order by imported_at, id) = 1),
m as (
  select conversation_id, sequence_index as q, content_text, coalesce(regexp_matches(content_text, '[^\p{Z}\p{C}]'), false) as v,
    case lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'model' then 'assistant'
      when 'system' then 'system' when 'tool' then 'tool' end as speaker from kept where conversation_id is not null),
c as (
  select conversation_id, bool_or(v) as visible, count(*) as n, count(q) as nq, count(distinct q) as dq, min(q) as lo, max(q) - min(q) + 1 as span, count(speaker) as ns,
    string_agg(case when speaker = 'user' then 'u' when speaker = 'assistant' then case when v then 'a' else 'e' end else '' end, '' order by q) as turns from m group by 1),
j as (
  select u.conversation_id, c.lo, case when not coalesce(visible, false) then 'empty' when h.id is null or nq <> n or ns <> n or dq <> nq or span <> dq then 'broken'
    when regexp_matches(turns, 'u$|ue+u|ue+$') then 'unanswered' end as defect
  from (select id as conversation_id from conversations union select conversation_id from messages where conversation_id is not null) u
  left join (select distinct id from conversations) h on h.id = u.conversation_id left join c on c.conversation_id = u.conversation_id)"""


_EXACT_NEIGHBOURS = """
with ok as (select cache_id, embedding_model_version as v, embedding::double[] as e from embedding_cache where cache_id is not null and embedding_model_version is not null and len(embedding) = embedding_dimension
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
q as (select * from ok where cache_id in (select cache_id from probe_vectors)),
s as (select q.cache_id as a, o.cache_id as b, list_cosine_similarity(q.e, o.e) as sim from q join ok o on o.v = q.v and len(o.e) = len(q.e) and o.cache_id <> q.cache_id),
r as (select a, b from s qualify row_number() over (partition by a order by sim desc, b) <= 10)
select distinct least(a, b) as cache_id_a, greatest(a, b) as cache_id_b from r"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _EXACT_NEIGHBOURS,
        "p5_found": f"with {_VERDICTS} select conversation_id, defect from j where defect is not null",
        "p5_dialogues": f"with {_VERDICTS} select m.conversation_id, q - lo as turn, speaker, content_text from m join j on j.conversation_id = m.conversation_id where defect is null",
    }
