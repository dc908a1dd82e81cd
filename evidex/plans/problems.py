"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidex.operators import deliveries, history, timestamps
from evidex.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.deliver_in_order(load(spark, d, "messages"))[0].select("message_id")


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.deliver_in_order(load(spark, d, "messages"))[1].ranges


def _feeds(spark: SparkSession, d: str) -> list[DataFrame]:
    return [timestamps.message_values(load(spark, d, "messages"), load(spark, d, "ingest_results")), timestamps.corpus_values(load(spark, d, "corpus_rows"))]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(_feeds(spark, d), skip_canonical=True).where("utc_us is not null")


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(_feeds(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return history.belief_versions(load(spark, d, "beliefs")).select(*history.KEY, "valid_from_us", "valid_to_us")


def p7_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.belief_versions(load(spark, d, "beliefs"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_ranges, p4_found, p4_normalised, p7_found, p7_versions)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"""
select id as message_id from (
  select id, row_number() over (partition by source_id, lower(regexp_replace(external_id, '^\s+|\s+$', '', 'g')) order by imported_at, id) as n
  from messages where external_id is not null and source_id is not null
) where n > 1""",
        "p7_found": r"""
with s as (
  select subject_normalized, predicate, group_object_key, epoch_us(coalesce(valid_from, observed_at)) as e, epoch_us(valid_to) as vt, object_text, status from beliefs where coalesce(valid_from, observed_at) is not null
  qualify row_number() over (partition by subject_normalized, predicate, group_object_key, coalesce(valid_from, observed_at) order by recorded_at desc, id desc) = 1),
f as (
  select *, last_value(object_text ignore nulls) over p as o, last_value(status ignore nulls) over p as st, lead(e) over w as nx from s
  window w as (partition by subject_normalized, predicate, group_object_key order by e), p as (partition by subject_normalized, predicate, group_object_key order by e rows unbounded preceding)),
l as (
  select *, least(coalesce(vt, 9223372036854775807), coalesce(nx, 9223372036854775807)) as u, lower(trim(regexp_replace(o, '\s+', ' ', 'g'))) as n from f
  where (st is null or lower(st) not in ('rejected', 'superseded')) and least(coalesce(vt, 9223372036854775807), coalesce(nx, 9223372036854775807)) > e),
g as (
  select *, case when lag(u) over w = e and lag(st) over w is not distinct from st and lag(n) over w is not distinct from n then 0 else 1 end as b from l
  window w as (partition by subject_normalized, predicate, group_object_key order by e)),
h as (select *, sum(b) over (partition by subject_normalized, predicate, group_object_key order by e rows unbounded preceding) as i from g)
select subject_normalized, predicate, group_object_key, min(e) as valid_from_us, case when max(u) = 9223372036854775807 then -1 else max(u) end as valid_to_us
from h group by subject_normalized, predicate, group_object_key, i""",
        "p2_ranges": r"""
with k as (select distinct source_id, lower(regexp_replace(external_id, '^\s+|\s+$', '', 'g')) as key from messages where external_id is not null and source_id is not null),
n as (select source_id, regexp_extract(key, '^(.*[^0-9].*|[^0-9]):(0|[1-9][0-9]{0,16})$', 1) as producer, try_cast(regexp_extract(key, '^(.*[^0-9].*|[^0-9]):(0|[1-9][0-9]{0,16})$', 2) as bigint) as number from k),
i as (select *, number - row_number() over (partition by source_id, producer order by number) as island from n where producer <> '' and number is not null)
select source_id, producer, min(number) as lo, max(number) as hi from i group by source_id, producer, island""",
        "p7_versions": r"""
with s as (
  select subject_normalized, predicate, group_object_key, epoch_us(coalesce(valid_from, observed_at)) as e, epoch_us(valid_to) as vt, object_text, status from beliefs where coalesce(valid_from, observed_at) is not null
  qualify row_number() over (partition by subject_normalized, predicate, group_object_key, coalesce(valid_from, observed_at) order by recorded_at desc, id desc) = 1),
f as (
  select *, last_value(object_text ignore nulls) over p as o, last_value(status ignore nulls) over p as st, lead(e) over w as nx from s
  window w as (partition by subject_normalized, predicate, group_object_key order by e), p as (partition by subject_normalized, predicate, group_object_key order by e rows unbounded preceding)),
k as (select *, lower(trim(regexp_replace(o, '\s+', ' ', 'g'))) as n, lower(trim(regexp_replace(st, '\s+', ' ', 'g'))) as sn from f),
c as (
  select *, case when row_number() over w = 1 or lag(n) over w is distinct from n then 1 else 0 end as nc, case when row_number() over w = 1 or lag(sn) over w is distinct from sn then 1 else 0 end as sc from k
  window w as (partition by subject_normalized, predicate, group_object_key order by e)),
r as (select *, sum(nc) over p as nr, sum(sc) over p as sr from c window p as (partition by subject_normalized, predicate, group_object_key order by e rows unbounded preceding)),
x as (select *, first_value(o) over (partition by subject_normalized, predicate, group_object_key, nr order by e) as held, first_value(st) over (partition by subject_normalized, predicate, group_object_key, sr order by e) as was from r),
l as (
  select *, least(coalesce(vt, 9223372036854775807), coalesce(nx, 9223372036854775807)) as u from x
  where (st is null or sn not in ('rejected', 'superseded')) and least(coalesce(vt, 9223372036854775807), coalesce(nx, 9223372036854775807)) > e),
g as (
  select *, case when lag(u) over w = e and lag(sn) over w is not distinct from sn and lag(n) over w is not distinct from n then 0 else 1 end as b from l
  window w as (partition by subject_normalized, predicate, group_object_key order by e)),
h as (select *, sum(b) over (partition by subject_normalized, predicate, group_object_key order by e rows unbounded preceding) as i from g)
select subject_normalized, predicate, group_object_key, first(held order by e) as object_text, first(was order by e) as status, min(e) as valid_from_us, case when max(u) = 9223372036854775807 then -1 else max(u) end as valid_to_us
from h group by subject_normalized, predicate, group_object_key, i""",
    }
