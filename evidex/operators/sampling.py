"""Choosing what to look at next: answers, cooldowns, caps, coverage, comparison tags, queue order, run metrics.

All are filters, joins and aggregates over keyed rows. Keys may be null and null equals null; empty tables give no rows
(metrics: zeros); ties are broken by the last column of an order; extra columns pass through or are ignored as stated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import safe_rate
from evidex.operators.relational import null_safe

# How pressing a comparison tag and a data state are, first to last.
RISKS = ["zeroed", "high_drop_count", "provenance_anomaly", "count_changed", "predicate_mix_changed", "newly_nonzero", "unchanged"]
STATES = ["candidate_zero", "complete", "candidate_redacted", "candidate_malformed", "candidate_missing", "prior_missing"]


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to every value given; a parameter that is None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def last_answers(labels: DataFrame, keys: list[str], at: str, verdict: str, skip: str) -> DataFrame:
    """keys, last_at: the latest answer of each target that is no skip; an answer without verdict counts."""
    return labels.where(~F.col(verdict).eqNullSafe(F.lit(skip))).groupBy(*keys).agg(F.max(at).alias("last_at"))


def after_cooldown(pool: DataFrame, answers: DataFrame, keys: list[str], kind: str, days: dict[str, int], default: int, as_of: datetime) -> DataFrame:
    """Rows of pool never answered, or whose last answer (keys, last_at) is at least their kind's days before as_of."""
    wait = F.coalesce(F.create_map(*(F.lit(x) for kv in days.items() for x in kv))[F.col(kind)], F.lit(default)) if days else F.lit(default)
    joined = pool.join(answers.withColumnsRenamed({k: f"__{k}" for k in keys}), _on(pool, keys), "left")
    due = F.col("last_at").isNull() | (F.col("last_at") <= F.lit(as_of) - F.make_interval(days=wait))
    return joined.where(due).select(*pool.columns)


def _on(df: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"__{k}"))
    return on


def below_cap(pool: DataFrame, labels: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of pool with fewer than most labels of the same keys; a cap of 0 or less filters nothing."""
    if most <= 0:
        return pool
    full = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
    return pool.join(full, null_safe(pool, full, keys), "left_anti")


def progress(targets: DataFrame, labels: DataFrame, session: str, keys: list[str]) -> DataFrame:
    """session, targets, answered, open: how many of a session's distinct targets have a label."""
    have = labels.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct().withColumn("__hit", F.lit(1))
    each = targets.select(session, *keys).distinct()
    seen = each.join(have, _on(each, keys), "left").groupBy(session).agg(F.count(F.lit(1)).alias("targets"), F.count("__hit").alias("answered"))
    return seen.withColumn("open", F.col("targets") - F.col("answered"))


def coverage(targets: DataFrame, labels: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """kind, targets, labelled, rate over the distinct targets of each kind."""
    p = progress(targets, labels, kind, keys)
    return p.select(kind, "targets", F.col("answered").alias("labelled"), F.round(safe_rate(F.col("answered"), F.col("targets")), 6).alias("rate"))


def first_rows(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group with their position; the window keeps a limit of most per group before the shuffle."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("position", at).where(F.col("position") <= most)


def size_bucket(messages: Column, chars: Column) -> Column:
    """short, medium or long by number of messages and characters."""
    return F.when((messages <= 2) & (chars < 2000), "short").when((messages <= 8) & (chars < 8000), "medium").otherwise("long")


def shortfalls(rows: DataFrame, bucket: str, target: int) -> DataFrame:
    """bucket, available, picked, shortfall of a plan that wants target rows of each bucket."""
    n = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("available"))
    return n.select(bucket, "available", F.least("available", F.lit(target)).alias("picked"), F.greatest(F.lit(target) - F.col("available"), F.lit(0)).alias("shortfall"))


def latency_summary(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, n, min, mean, p50, p95, max of value, percentiles exact with linear interpolation."""
    r = lambda c: F.round(c, 6)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), r(F.min(value)).alias("min"), r(F.avg(value)).alias("mean"), r(F.percentile(value, 0.5)).alias("p50"), r(F.percentile(value, 0.95)).alias("p95"), r(F.max(value)).alias("max")
    )


def run_metrics(segments: DataFrame, claims: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: segments, those with a claim and their rate, claims, dropped claims and their rate. checked: id, reason."""
    s = segments.select(F.col("id").alias("segment_id")).join(claims.select("segment_id").distinct().withColumn("hit", F.lit(1)), "segment_id", "left").agg(F.count(F.lit(1)).alias("segments_total"), F.count("hit").alias("segments_completed"))
    c = checked.agg((F.count(F.lit(1)) - F.count("reason")).alias("claim_count"), F.count("reason").alias("dropped_claim_count"))
    both = s.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")  # two results of one row each
    return both.select(
        "*", F.round(safe_rate(F.col("segments_completed"), F.col("segments_total")), 6).alias("segment_completion_rate"),
        F.round(safe_rate(F.col("dropped_claim_count"), F.col("claim_count") + F.col("dropped_claim_count")), 6).alias("dropped_claim_rate"),
    )


def data_state(malformed: Column, missing: Column, prior_missing: Column, redacted: Column, candidates: Column) -> Column:
    """The one state of a comparison, the first that applies."""
    return (
        F.when(malformed, "candidate_malformed").when(missing, "candidate_missing").when(prior_missing, "prior_missing")
        .when(redacted, "candidate_redacted").when(candidates == 0, "candidate_zero").otherwise("complete")
    )


def comparison_tags(prior: Column, candidate: Column, dropped: Column, prior_kinds: Column, kinds: Column, prior_evidence: Column, evidence: Column, high_drop: int = 3) -> Column:
    """Array of tags in the order of RISKS: what differs between the claims of two runs; counts may be null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    tag = lambda c, name: F.when(yes(c), F.lit(name))
    no = F.array().cast("array<string>")
    a, b = F.coalesce(prior_kinds, no), F.coalesce(kinds, no)
    found = F.array_compact(F.array(
        tag((prior > 0) & (candidate == 0), "zeroed"), tag(dropped >= high_drop, "high_drop_count"),
        tag((candidate > 0) & (evidence.isNull() | (evidence == 0) | yes(evidence < prior_evidence)), "provenance_anomaly"),
        tag(prior != candidate, "count_changed"), tag((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0), "predicate_mix_changed"),
        tag((prior == 0) & (candidate > 0), "newly_nonzero"),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("unchanged"))).otherwise(found)


def rank_of(value: Column, order: list[str]) -> Column:
    """Position in a list, 99 outside."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), value)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def compare_segments(prior: DataFrame, candidate: DataFrame) -> DataFrame:
    """segment_id, state, tags, state_rank, risk_rank of every segment of two sets of claims (segment_id, predicate, evidence_message_ids)."""
    def summary(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("segment_id").agg(F.count(F.lit(1)).alias(f"{p}n"), F.collect_set("predicate").alias(f"{p}k"), F.sum(F.size("evidence_message_ids")).alias(f"{p}e"))

    x = summary(prior, "p").join(summary(candidate, "c"), "segment_id", "full")
    none = F.lit(False)
    state = data_state(none, none, F.col("pn").isNull(), none, F.coalesce("cn", F.lit(0)))
    tags = comparison_tags(F.col("pn"), F.coalesce("cn", F.lit(0)), F.lit(None).cast("int"), F.col("pk"), F.col("ck"), F.col("pe"), F.col("ce"))
    x = x.select("segment_id", state.alias("state"), tags.alias("tags"))
    return x.withColumns({"state_rank": rank_of(F.col("state"), STATES), "risk_rank": rank_of(F.col("tags")[0], RISKS)})


def queue(compared: DataFrame, most: int) -> DataFrame:
    """The first of a review queue: by state, then the most pressing tag, then id."""
    return compared.orderBy("state_rank", "risk_rank", "segment_id").limit(most)


def within_retry_budget(scopes: DataFrame, progress_rows: DataFrame, key: str, budget: int = 3) -> DataFrame:
    """Scopes whose error_count (0 without a row) is below the budget."""
    spent = progress_rows.where(F.col("error_count") >= budget).select(F.col(key).alias("__k")).distinct()
    return scopes.join(spent, F.col(key).eqNullSafe(F.col("__k")), "left_anti")


def update_from(rows: DataFrame, source: DataFrame, key: str, source_key: str, assign: dict[str, Column]) -> DataFrame:
    """rows after an UPDATE ... FROM: where source has the key, columns take the assigned values (over columns of source named src_*)."""
    s = source.dropDuplicates([source_key]).select(*(F.col(c).alias(f"src_{c}") for c in source.columns))
    joined = rows.join(s, rows[key] == s[f"src_{source_key}"], "left")
    hit = F.col(f"src_{source_key}").isNotNull()
    return joined.select(*(F.when(hit, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in rows.columns))


def stale(rows: DataFrame, status: str, waiting: str, at: str, as_of: datetime, seconds: int) -> DataFrame:
    """Rows in the waiting status since more than seconds before as_of."""
    return rows.where((F.col(status) == waiting) & (F.col(at) < F.lit(as_of) - F.make_interval(secs=F.lit(seconds))))


def only_latest(rows: DataFrame, keys: list[str], order: list[str], status: str, current: str, old: str) -> DataFrame:
    """rows whose status is rewritten so that of each key only the latest row in the status current keeps it; a window per key, whose rows are few."""
    n = F.row_number().over(Window.partitionBy(*keys, F.col(status) == current).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", n).withColumn(status, F.when((F.col(status) == current) & (F.col("__n") > 1), old).otherwise(F.col(status))).drop("__n")


def parent_mismatches(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, same: list[str]) -> DataFrame:
    """child rows' id and the first of the columns same in which they differ from their parent (null equals null), or 'unknown parent'."""
    p = parents.select(F.col(parent_key).alias("__p"), *(F.col(c).alias(f"__{c}") for c in same))
    reason = F.when(F.col("__p").isNull(), "unknown parent")
    for c in same:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c)
    return children.join(p, F.col(child_key) == F.col("__p"), "left").select("id", reason.alias("reason")).where("reason is not null")
