"""Review queues, displays, run comparison, audits: relational summaries over beliefs and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import excerpt, has_content_key, opened_id
from evidex.functions.times import epoch_us, export_us
from evidex.operators.relational import distribution_l1, secure_view


def priority(open_contradictions: Column, invalidated: Column, tier: Column, stability: Column, confidence: Column) -> Column:
    """Rank of a belief for review: open contradictions, invalidated claims, privacy, identity, low confidence."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    doubt = F.round((1 - F.coalesce(confidence, F.lit(0.0)).cast("decimal(10,6)")) * 10, 2).cast("double")
    return flag(open_contradictions > 0, 100) + flag(invalidated > 0, 50) + flag(tier > 1, 20) + flag(stability.isin("identity", "relationship"), 10) + doubt


def review_queue(beliefs: DataFrame, links: DataFrame, lost_claims: DataFrame) -> DataFrame:
    """id, contradictions, invalidated, priority of beliefs. links: (a, b) open contradictions; lost_claims: id.

    A contradiction counts for both its ends through an exploded equi-join, cited claims through their exploded ids.
    """
    ends = links.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("contradictions"))
    cited = beliefs.select("id", F.explode(F.array_distinct("claim_ids")).alias("claim"))
    gone = cited.join(lost_claims.select(F.col("id").alias("claim")).distinct(), "claim").groupBy("id").agg(F.count(F.lit(1)).alias("invalidated"))
    rows = beliefs.select("id", "privacy_tier", "stability_class", "confidence").join(ends, "id", "left").join(gone, "id", "left").fillna(0, ["contradictions", "invalidated"])
    return rows.select("id", "contradictions", "invalidated", priority(F.col("contradictions"), F.col("invalidated"), F.col("privacy_tier"), F.col("stability_class"), F.col("confidence")).alias("priority"))


def target_display(claims: DataFrame, messages: DataFrame, limit: int = 160) -> DataFrame:
    """id, evidence, first_us, last_us, excerpt (of the earliest evidence) of each claim. Times as in claims.evidence_interval()."""
    at = F.coalesce(export_us(F.col("created_at")), epoch_us("imported_at"))
    m = messages.select(F.col("id").alias("m_id"), at.alias("at"), excerpt(F.col("content_text"), limit).alias("text"))
    rows = claims.select("id", F.explode(F.array_distinct("evidence_message_ids")).alias("m_id")).join(m, "m_id")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("evidence"), F.min("at").alias("first_us"), F.max("at").alias("last_us"), F.min_by("text", F.struct("at", "m_id")).alias("excerpt"))


def tag_counts(rows: DataFrame, tags: str, state: str) -> DataFrame:
    """kind, value, n: rows by tag (exploded) and by state ('undecided' where null)."""
    by_tag = rows.select(F.lit("tag").alias("kind"), F.explode(tags).alias("value"))
    by_state = rows.select(F.lit("state").alias("kind"), F.coalesce(state, F.lit("undecided")).alias("value"))
    return by_tag.unionByName(by_state).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def transitions(beliefs: DataFrame) -> DataFrame:
    """One audit row per step of consolidated beliefs: insert at valid_from, close at valid_to."""
    keys = ["subject_normalized", "predicate", "group_object_key", "value"]
    start = beliefs.select(*keys, F.lit("insert").alias("step"), F.col("valid_from").alias("at"))
    end = beliefs.where("valid_to is not null").select(*keys, F.lit("close").alias("step"), F.col("valid_to").alias("at"))
    return start.unionByName(end)


def result_kind(claims: Column, dropped: Column) -> Column:
    """populated, accounted_zero (nothing valid but something dropped) or clean_zero."""
    return F.when(claims > 0, "populated").when(dropped > 0, "accounted_zero").otherwise("clean_zero")


def behind_version(segments: DataFrame, extractions: DataFrame, target: str) -> DataFrame:
    """segment_id, versions of segments whose latest extraction is not at the target version. extractions: segment_id, version, created_at, id."""
    done = extractions.groupBy("segment_id").agg(F.max_by("version", F.struct("created_at", "id")).alias("latest"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    return segments.select("segment_id").join(done, "segment_id", "left").where(~F.col("latest").eqNullSafe(F.lit(target))).select("segment_id", F.coalesce("versions", F.lit("<none>")).alias("versions"))


def compare_runs(control: DataFrame, candidate: DataFrame, key: str, kind: str) -> DataFrame:
    """shared, only_control, only_candidate keys, rows of each, and the distance of their distributions of kind."""
    a = control.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    b = candidate.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, key, "full").agg(
        F.count(F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("nb").isNull(), 1)).alias("only_control"),
        F.count(F.when(F.col("na").isNull(), 1)).alias("only_candidate"), F.sum("na").alias("control_rows"), F.sum("nb").alias("candidate_rows"),
    )
    # two results of one row each
    return both.withColumn("one", F.lit(1)).join(distribution_l1(control, candidate, kind).withColumn("one", F.lit(1)), "one").drop("one")


def fetch(corpus: DataFrame, reference: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """The row of an opaque reference, if its tenant and corpus are allowed."""
    one = corpus.sparkSession.createDataFrame([(reference,)], "r string").select(opened_id(F.col("r"), "corpus_id string, item_id string, tenant_id string").alias("x")).first()["x"]
    if one is None:
        raise ValueError("no reference")
    return secure_view(corpus, allowed).where((F.col("item_id") == one["item_id"]) & (F.col("tenant_id") == one["tenant_id"]) & (F.col("corpus_id") == one["corpus_id"]))


def audit_defects(audits: DataFrame, reasons: list[str]) -> DataFrame:
    """id, defect of audits (id, payload, omitted) that hold content or unknown omission reasons."""
    unknown = F.size(F.array_except(F.coalesce("omitted", F.array().cast("array<string>")), F.array(*(F.lit(r) for r in reasons)))) > 0
    return audits.select("id", F.when(has_content_key(F.col("payload")), "content key").when(unknown, "unknown reason").alias("defect")).where("defect is not null")


def fixture_errors(lines: DataFrame, version: str) -> DataFrame:
    """line, error of JSONL fixtures (line, value): header first, version, kinds, ids unique, references known. All errors, none raised."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    rows = lines.select("line", "value", get("kind").alias("kind"), get("id").alias("id"), get("schema_version").alias("schema_version"), F.from_json(get("message_ids"), "array<string>").alias("refs"))
    first = F.min("line").over(Window.partitionBy())  # fixtures are small
    local = rows.withColumn("first", first).select("line", F.explode(F.array_compact(F.array(
        F.when(F.col("kind").isNull(), "no kind"), F.when((F.col("line") == F.col("first")) & (F.col("kind") != "header"), "header must be first"), F.when((F.col("line") != F.col("first")) & (F.col("kind") == "header"), "second header"),
        F.when((F.col("kind") == "header") & ~F.col("schema_version").eqNullSafe(F.lit(version)), "schema version"), F.when((F.col("kind") != "header") & F.col("id").isNull(), "no id"),
    ))).alias("error"))
    twice = rows.where("id is not null").groupBy("kind", "id").agg(F.max("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n > 1").select("line", F.concat(F.lit("repeated id "), "id").alias("error"))
    known = rows.where("kind = 'message'").select(F.col("id").alias("ref"))
    lost = rows.select("line", F.explode("refs").alias("ref")).join(known, "ref", "left_anti").select("line", F.concat(F.lit("unknown message "), "ref").alias("error"))
    return local.unionByName(twice).unionByName(lost)
