"""Claim validation and chunking, and consolidation of claims into beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.text import canonical_json, normalize_subject, normalize_value
from evidex.functions.times import epoch_us, export_us
from evidex.operators import timestamps
from evidex.operators.history import KEY, _neighbours
from evidex.session import stage

# Predicate, stability, cardinality, object kind, keys that group objects, required keys.
VOCABULARY = [
    ("has_name", "identity", "single_current", "text", "", ""),
    ("has_pronouns", "identity", "single_current", "text", "", ""),
    ("born_on", "identity", "single_current", "text", "", ""),
    ("lives_at", "identity", "single_current", "json", "", "address_line1"),
    ("holds_role_at", "identity", "single_current", "json", "", "role,employer"),
    ("has_pet", "identity", "multi_current", "json", "name,species", "species"),
    ("is_related_to", "relationship", "multi_current", "json", "name", "name,kind"),
    ("is_friends_with", "relationship", "multi_current", "text", "text", ""),
    ("works_with", "relationship", "multi_current", "text", "text", ""),
    ("prefers", "preference", "multi_current", "text", "text", ""),
    ("dislikes", "preference", "multi_current", "text", "text", ""),
    ("believes", "preference", "multi_current", "text", "text", ""),
    ("uses_tool", "preference", "multi_current", "text", "text", ""),
    ("drives", "preference", "single_current", "text", "", ""),
    ("eats_diet", "preference", "single_current", "text", "", ""),
    ("working_on", "project_status", "multi_current", "text", "text", ""),
    ("project_status_is", "project_status", "single_current_per_object", "json", "project", "project,status"),
    ("owns_repo", "project_status", "multi_current", "text", "text", ""),
    ("wants_to", "goal", "multi_current", "text", "text", ""),
    ("plans_to", "goal", "multi_current", "json", "action", "action"),
    ("intends_to", "goal", "multi_current", "text", "text", ""),
    ("must_do", "task", "event", "text", "text", ""),
    ("committed_to", "task", "event", "json", "action,with_party", "action"),
    ("feels", "mood", "multi_current", "text", "text", ""),
    ("relationship_with", "relationship", "single_current_per_object", "json", "name", "name,status"),
    ("met_with", "relationship", "event", "json", "name,when", "name"),
    ("talked_about", "preference", "event", "text", "text", ""),
    ("studied", "identity", "multi_current", "text", "text", ""),
    ("traveled_to", "identity", "event", "json", "place,when", "place"),
]

#: Columns of traced() claims that a belief's evidence is taken from.
TRACE = ("evidence_from", "evidence_to", "evidence_message_ids")


def vocabulary(spark: SparkSession) -> DataFrame:
    """The predicate vocabulary, marked for broadcast: its size is fixed above."""
    df = spark.createDataFrame(VOCABULARY, "predicate string, v_stability string, v_cardinality string, v_kind string, v_group string, v_required string")
    return F.broadcast(df.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in ("v_group", "v_required")}))


def validate(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """id, reason: the first defect of each claim, null if it is valid. Evidence must lie in the claim's segment."""
    s = segments.select(F.col("id").alias("segment_id"), F.col("message_ids").alias("allowed"))
    rows = claims.join(vocabulary(claims.sparkSession), "predicate", "left").join(s, "segment_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    keys = F.coalesce(F.json_object_keys("object_json"), F.array().cast("array<string>"))
    missing = F.array_except("v_required", keys)
    reason = (
        F.when(blank("subject_text"), "subject_text is empty")
        .when(F.col("v_kind").isNull(), F.concat(F.lit("unknown predicate: "), "predicate"))
        .when(~F.col("stability_class").eqNullSafe(F.col("v_stability")), "stability_class does not match the vocabulary")
        .when(F.coalesce(F.size("evidence_message_ids"), F.lit(0)) <= 0, "evidence is empty")
        .when(F.size(F.array_except("evidence_message_ids", F.coalesce("allowed", F.array().cast("array<string>")))) > 0, "evidence outside of the segment")
        .when(F.col("object_text").isNull() == F.col("object_json").isNull(), "exactly one object is required")
        .when((F.col("v_kind") == "text") & blank("object_text"), "predicate requires object_text")
        .when((F.col("v_kind") == "json") & (F.col("object_json").isNull() | ~F.ltrim("object_json").startswith("{")), "predicate requires object_json")
        .when((F.col("v_kind") == "json") & (F.size(missing) > 0), F.concat(F.lit("object_json lacks "), missing[0]))
    )
    return rows.select("id", reason.alias("reason"))


def normalize_drafts(claims: DataFrame) -> DataFrame:
    """claims with the vocabulary's stability class, and without an object of the wrong kind where the right one is there."""
    v = claims.join(vocabulary(claims.sparkSession), "predicate", "left")
    text = F.when((F.col("v_kind") == "json") & F.col("object_json").isNotNull(), None).otherwise(F.col("object_text"))
    js = F.when((F.col("v_kind") == "text") & F.col("object_text").isNotNull(), None).otherwise(F.col("object_json"))
    return v.select(
        *(c for c in claims.columns if c not in ("object_text", "object_json", "stability_class")), F.coalesce("v_stability", "stability_class").alias("stability_class"), text.alias("object_text"), js.alias("object_json")
    )


def drop_rate(checked: DataFrame) -> DataFrame:
    """inserted, dropped and the dropped share of validated claims (0 without any)."""
    n, bad = F.count(F.lit(1)), F.count("reason")
    return checked.agg((n - bad).alias("inserted"), bad.alias("dropped"), F.round(F.when(n == 0, 0.0).otherwise(bad / n), 6).alias("drop_rate"))


def object_shape(claims: DataFrame) -> DataFrame:
    """id and the redacted shape of a claim: predicate, kinds of its objects, sorted keys, amount of evidence. No values."""
    return claims.select(
        "id", "predicate", "stability_class", F.when(F.col("object_text").isNull(), "null").otherwise("text").alias("object_text_type"),
        F.when(F.col("object_json").isNull(), "null").otherwise("object").alias("object_json_type"),
        F.array_join(F.array_sort(F.coalesce(F.json_object_keys("object_json"), F.array().cast("array<string>"))), ",").alias("object_keys"), F.coalesce(F.size("evidence_message_ids"), F.lit(0)).alias("evidence"),
    )


def chunks(segment_messages: DataFrame, most: int = 12, chars: int = 6000) -> DataFrame:
    """segment_id, at, chunk: messages of a segment (segment_id, at, n_chars) in chunks bounded by number and characters.

    A segment's messages are few, so each is folded on its own.
    """
    item = F.struct("at", "n_chars")
    folded = segment_messages.groupBy("segment_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<struct<at:int,chunk:int>>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("chunk"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["size"] + x["n_chars"] > chars))
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(
            F.array_append(acc["out"], F.struct(x["at"].cast("int").alias("at"), chunk.alias("chunk"))).alias("out"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, x["n_chars"]).otherwise(acc["size"] + x["n_chars"]).cast("long").alias("size"), chunk.alias("chunk"),
        )

    return folded.select("segment_id", F.inline(F.aggregate("items", start, step, lambda a: a["out"])))


def halves(parts: DataFrame) -> DataFrame:
    """key, half (0, 1), items, text: each part (key, items, text) split in two, by its items, or by the text of its only one.

    A part without items, or of one with less than two characters, gives no halves.
    """
    n, chars = F.size("items"), F.length(F.coalesce("text", F.lit("")))
    cut = F.when(n > 1, F.greatest(F.lit(1), F.floor(n / 2)).cast("int"))
    at = F.floor(chars / 2).cast("int")
    half = lambda h: F.struct(
        F.lit(h).alias("half"), F.when(n > 1, F.slice("items", 1, cut) if h == 0 else F.slice("items", cut + 1, n)).otherwise(F.col("items")).alias("items"),
        F.when(n == 1, F.substring(F.col("text"), F.lit(1), at) if h == 0 else F.substring(F.col("text"), at + 1, chars)).alias("text"),
    )
    return parts.where((n > 1) | ((n == 1) & (chars >= 2))).select("key", F.inline(F.array(half(0), half(1))))


# The keys of a claim in a payload, and the stability classes.
PAYLOAD_KEYS = ["subject_text", "predicate", "object_text", "object_json", "stability_class", "confidence", "evidence_message_ids", "rationale"]
STABILITY = ["identity", "preference", "project_status", "goal", "task", "mood", "relationship"]


def payload_defects(payloads: DataFrame, relaxed: bool = False) -> DataFrame:
    """key, defect of payloads (key, payload): the first defect fails a payload as a whole, null if there is none.

    A payload is an object with only the key claims, a list of objects with exactly PAYLOAD_KEYS.
    """
    text = "array<string>"
    outer = F.json_object_keys("payload")
    items = F.from_json(F.get_json_object("payload", "$.claims"), text)
    rows = payloads.select("key", "payload", F.when(outer.isNull() | (F.array_join(outer, ",") != "claims"), "must contain only claims").when(items.isNull(), "claims must be a list").alias("whole"), items.alias("items"))
    one = rows.where("whole is null").select("key", F.posexplode("items").alias("n", "c"))
    get = lambda k: F.get_json_object("c", f"$.{k}")
    kind = lambda k: F.regexp_extract("c", rf'"{k}"\s*:\s*(.)', 1)  # noqa: E731 - the first character of a value tells its type
    names = [p for p, *_ in VOCABULARY]
    evidence = F.from_json(get("evidence_message_ids"), text)
    number = get("confidence").try_cast("double")
    defect = (
        F.when(~F.coalesce(F.array_join(F.array_sort(F.json_object_keys("c")), ",") == ",".join(sorted(PAYLOAD_KEYS)), F.lit(False)), "does not match the schema")
        .when((kind("subject_text") != '"') | (F.trim(get("subject_text")) == ""), "has empty subject_text")
        .when((kind("predicate") != '"') | (F.lit(not relaxed) & ~get("predicate").isin(*names)), "has invalid predicate")
        .when((kind("object_text") != "n") & ((kind("object_text") != '"') | (F.trim(get("object_text")) == "")), "has empty object_text")
        .when(~kind("object_json").isin("n", "{"), "has invalid object_json")
        .when((kind("stability_class") != '"') | ~get("stability_class").isin(*STABILITY), "has invalid stability_class")
        .when(kind("confidence").isin('"', "n", "t", "f", "[", "{") | number.isNull() | ~number.between(0, 1), "has invalid confidence")
        .when((kind("evidence_message_ids") != "[") | (F.coalesce(F.size(evidence), F.lit(0)) < 1) | F.exists(evidence, lambda x: x.isNull() | (x == "")), "has invalid evidence_message_ids")
        .when(kind("rationale") != '"', "has invalid rationale")
    )
    bad = one.select("key", "n", defect.alias("d")).where("d is not null").groupBy("key").agg(F.min_by(F.concat(F.lit("claim "), F.col("n").cast("string"), F.lit(" "), F.col("d")), "n").alias("d"))
    return rows.join(bad, "key", "left").select("key", F.coalesce("whole", "d").alias("defect"))


def group_key() -> Column:
    """Key that keeps apart the objects of one predicate: none, the object's text normalised like a subject, or the vocabulary's JSON fields."""
    parsed = F.from_json("object_json", "map<string,string>")
    fields = F.transform(F.col("v_group"), lambda k: F.coalesce(F.try_element_at(parsed, k), F.lit("")))
    return (
        F.when(F.col("v_cardinality") == "single_current", "")
        .when(F.col("object_text").isNotNull(), normalize_subject(F.col("object_text")))
        .otherwise(normalize_value(F.array_join(fields, "\u001f")))
    )


def active_claims(claims: DataFrame, segments: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Claims of active segments of the three products, of each segment's latest extraction where extractions are given.

    extractions: id, segment_id, status, created_at. Only those that ended as extracted count.
    """
    s = segments.where("is_active and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null").select(F.col("id").alias("segment_id")).distinct()
    kept = claims.where("conversation_id is not null").join(s, "segment_id", "left_semi")
    if extractions is None:
        return kept
    latest = extractions.where("status = 'extracted'").groupBy("segment_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("extraction_id"))
    return kept.join(latest, ["segment_id", "extraction_id"], "left_semi")


def evidence_times(claims: DataFrame, messages: DataFrame, batches: DataFrame) -> DataFrame:
    """m_id, at of the claims' evidence messages: when a message was written, where that can be read, else its delivery."""
    cited = messages.join(claims.select(F.explode("evidence_message_ids").alias("id")).distinct(), "id", "left_semi")
    written = timestamps.normalise([timestamps.message_values(cited, batches)]).groupBy("record_id").agg(F.min("utc_us").alias("us"))
    read = F.timestamp_micros("us")
    if dict(messages.dtypes)["imported_at"] == "timestamp_ntz":
        read = read.cast("timestamp_ntz")  # sessions are in UTC
    return cited.join(written, F.col("id") == F.col("record_id"), "left").groupBy(F.col("id").alias("m_id")).agg(F.min(F.coalesce(read, "imported_at")).alias("at"))


def export_times(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """m_id, at of the claims' evidence messages, as an importer reads them: created_at where it is an instant, else the delivery. at: microseconds."""
    cited = claims.select(F.explode("evidence_message_ids").alias("m_id")).distinct()
    at = messages.groupBy(F.col("id").alias("m_id")).agg(F.min(F.coalesce(export_us(F.col("created_at")), epoch_us("imported_at"))).alias("at"))
    return at.join(cited, "m_id", "left_semi")


def traced(claims: DataFrame, times: DataFrame) -> DataFrame:
    """claims with evidence_from and evidence_to, the first and last time of the evidence (times: m_id, at); null where none of it is known."""
    one = claims.select(F.col("id").alias("c_id"), F.explode(F.array_distinct("evidence_message_ids")).alias("m_id"))
    span = one.join(times, "m_id").groupBy("c_id").agg(F.min("at").alias("evidence_from"), F.max("at").alias("evidence_to"))
    return claims.join(span, F.col("id") == F.col("c_id"), "left").drop("c_id")


def value_groups(claims: DataFrame) -> DataFrame:
    """Claims grouped by conversation, key and value, with the sums a belief is made of.

    Of traced() claims also begins and observed_at, the ends of the evidence, and cited: extracted_at, id and evidence of each claim, in order.
    """
    v = claims.join(vocabulary(claims.sparkSession), "predicate")
    value = F.when(F.col("object_text").isNotNull(), F.concat(F.lit("text:"), normalize_subject(F.col("object_text")))).otherwise(F.concat(F.lit("json:"), canonical_json(F.col("object_json"))))
    v = v.select("id", "conversation_id", "subject_normalized", "predicate", group_key().alias("group_object_key"), value.alias("value"), "v_cardinality", "extracted_at", "confidence", "privacy_tier", *(c for c in TRACE if c in claims.columns))
    more, first_id = [], F.min("id")
    if set(TRACE) <= set(claims.columns):
        first_id = F.min_by("id", F.struct("extracted_at", "id"))
        more = [F.min("evidence_from").alias("begins"), F.max("evidence_to").alias("observed_at"), F.array_sort(F.collect_list(F.struct("extracted_at", "id", "evidence_message_ids"))).alias("cited")]
    return v.groupBy("conversation_id", *KEY, "value", "v_cardinality").agg(
        F.min("extracted_at").alias("first_at"), F.max("extracted_at").alias("last_at"), first_id.alias("first_id"), F.count(F.lit(1)).alias("claims"), F.sum("confidence").alias("confidence"), F.max("privacy_tier").alias("tier"), *more,
    )


def _islands(claims: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(value groups in the order of the fold with starts, island (the group that began the belief) and following (begin and value of the next belief), what they cite)."""
    trace = set(TRACE) <= set(claims.columns)
    begins, more = ("begins", ["observed_at"]) if trace else ("first_at", [])
    n = slices or int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = claims.groupBy("conversation_id").agg(F.max("extracted_at").alias("conversation_last"))
    groups = value_groups(claims).join(last, "conversation_id").withColumn("eff", F.struct("conversation_last", "conversation_id", "first_at", "first_id"))
    rows = stage(groups.repartitionByRange(n, *KEY, "eff").withColumn("slice", F.spark_partition_id()), "groups")
    cited = rows.select(F.col("first_id").alias("cites"), "cited") if trace else None  # joined at the end, not carried through the steps
    rows = rows.drop("cited")
    w = Window.partitionBy("slice", *KEY).orderBy("eff")
    rows = _neighbours(rows, last={"p_value": F.max_by("value", "eff"), "p_seen": F.max("eff")}, stored=True)
    rows = rows.withColumns({"before": F.lag("value").over(w), "seen": F.lag("eff").over(w)})
    single = F.col("v_cardinality").startswith("single")
    first = F.coalesce("seen", "p_seen").isNull()
    rows = rows.withColumn("first", first).withColumn("starts", first | (single & ~F.coalesce("before", "p_value").eqNullSafe(F.col("value"))))
    mark = F.when(F.col("starts"), F.col("eff"))
    rows = rows.select("slice", *KEY, "eff", "value", F.col(begins).alias("begins"), "claims", "confidence", "tier", "first", "starts", *more).withColumns(
        {"island": F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first(F.when(F.col("starts"), F.struct(F.col("begins").alias("at"), "value")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}
    )
    started = F.when(F.col("starts"), F.struct(F.col("begins").alias("at"), "value"))
    rows = _neighbours(rows, last={"p_island": F.max_by("island", "eff")}, first={"n_next": F.min_by(started, F.when(F.col("starts"), F.col("eff")))})
    return rows.withColumn("island", F.coalesce("island", "p_island")).withColumn("following", F.coalesce("next", "n_next")), cited


def consolidate(claims: DataFrame, slices: int | None = None) -> DataFrame:
    """Beliefs: key, value, valid_from, valid_to, claims, confidence, tier, contradicts (the value that replaced it).

    Conversations count in the order of their last claim, groups inside by their first. A group with the value of the
    active belief joins it; another value closes it and opens the next, unless the predicate allows several at once.
    Runs in slices like the history, so a hot key is no hot task.

    Of traced() claims a belief begins at the first evidence of its first group, not at the first extraction, and has
    observed_at, claim_ids and evidence_ids of all its groups, each id once, in their order.
    """
    rows, cited = _islands(claims, slices)
    following = F.col("following")
    united, names = [], []
    if cited is not None:
        rows = rows.join(cited, F.col("eff.first_id") == F.col("cites"))
        listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("eff", "cited"))), lambda g: g["cited"]))  # what one belief cites
        united = [F.max("observed_at").alias("observed_at"), F.array_distinct(listed["id"]).alias("claim_ids"), F.array_distinct(F.flatten(listed["evidence_message_ids"])).alias("evidence_ids")]
        names = ["observed_at", "claim_ids", "evidence_ids"]
    return (
        rows.groupBy(*KEY, "island")
        .agg(
            F.min_by("value", "eff").alias("value"), F.min_by("begins", "eff").alias("valid_from"), F.min_by(following["at"], "eff").alias("valid_to"), F.min_by(following["value"], "eff").alias("contradicts"),
            F.sum("claims").alias("claims"), F.round(F.sum("confidence") / F.sum("claims"), 6).alias("confidence"), F.max("tier").alias("tier"), *united,
        )
        .select(*KEY, F.col("island.first_id").alias("first_claim"), "value", "valid_from", "valid_to", "claims", "confidence", "tier", "contradicts", *names)
    )


def audit(claims: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per transition of the fold: belief (its first claim), group (the group's first claim), step, previous_status, new_status, valid_to, claims, mean.

    A group begins a belief (insert, no status before) or is merged into it (supersede: the belief so far gives way to one that
    holds the group too, valid_to unchanged). A belief that another value replaces is closed where that one begins.
    claims and mean are those of the group, for a close those of the belief's last group.
    """
    rows, _ = _islands(claims, slices)
    mean = F.round(F.col("confidence") / F.col("claims"), 6).alias("mean")
    none = F.lit(None).cast("string")
    own = rows.select(
        *KEY, F.col("island.first_id").alias("belief"), F.col("eff.first_id").alias("group"), F.when(F.col("starts"), "insert").otherwise("supersede").alias("step"),
        F.when(F.col("starts"), none).otherwise("candidate").alias("previous_status"), F.when(F.col("starts"), "candidate").otherwise("superseded").alias("new_status"),
        F.lit(None).cast(rows.schema["begins"].dataType).alias("valid_to"), "claims", mean,
    )
    # the last group of a belief knows where the next one begins
    last = rows.groupBy(*KEY, "island").agg(F.max_by(F.struct("following", "claims", "confidence"), "eff").alias("x")).where("x.following is not null")
    closed = last.select(
        *KEY, F.col("island.first_id").alias("belief"), F.col("island.first_id").alias("group"), F.lit("close").alias("step"), F.lit("candidate").alias("previous_status"), F.lit("superseded").alias("new_status"),
        F.col("x.following.at").alias("valid_to"), F.col("x.claims").alias("claims"), F.round(F.col("x.confidence") / F.col("x.claims"), 6).alias("mean"),
    )
    return own.unionByName(closed)


def periods_apart(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether one of two periods ends before the other begins; an open period (null end) ends before none."""
    return F.coalesce(a_to <= b_from, F.lit(False)) | F.coalesce(b_to <= a_from, F.lit(False))


def contradictions(beliefs: DataFrame) -> DataFrame:
    """Pairs of successive values of a key and whether their periods are apart, which resolves them.

    A belief is closed where its successor begins, so that one's begin is this one's end; only a later contradiction may end it.
    """
    apart = periods_apart(F.col("valid_from"), F.col("valid_to"), F.col("valid_to"), F.lit(None).cast(beliefs.schema["valid_to"].dataType))
    return beliefs.where("contradicts is not null").select(*KEY, "value", "contradicts", F.col("valid_to").alias("at"), apart.alias("apart"))


def orphaned(beliefs: DataFrame, active_claims: DataFrame) -> DataFrame:
    """belief_id, lost, left of beliefs that cite claims no longer active; without any left they fall, else are recomputed."""
    cited = beliefs.select(F.col("id").alias("belief_id"), F.explode(F.array_distinct("claim_ids")).alias("claim_id"))
    seen = cited.join(active_claims.select(F.col("id").alias("claim_id")).distinct().withColumn("live", F.lit(1)), "claim_id", "left")
    return seen.groupBy("belief_id").agg((F.count(F.lit(1)) - F.count("live")).alias("lost"), F.count("live").alias("left")).where("lost > 0")


def orphan_causes(lost: DataFrame, claims: DataFrame, segments: DataFrame) -> DataFrame:
    """belief_id, cause of lost citations (belief_id, claim_id): reclassified if any claim's segment is invalidated, else deactivated if any is inactive, else reextraction."""
    s = segments.select(F.col("id").alias("segment_id"), F.col("invalidated_at").isNotNull().alias("gone"), "is_active")
    k = claims.select(F.col("id").alias("claim_id"), "segment_id").join(s, "segment_id")
    facts = lost.join(k, "claim_id", "left").groupBy("belief_id").agg(F.bool_or("gone").alias("gone"), F.bool_or(~F.col("is_active") & ~F.col("gone")).alias("off"))
    return facts.select("belief_id", F.when(F.col("gone"), "reclassified").when(F.col("off"), "deactivated").otherwise("reextraction").alias("cause"))


def orphan_decisions(beliefs: DataFrame, claims: DataFrame, segments: DataFrame) -> DataFrame:
    """belief_id, lost, kept, cause, decision of current beliefs that cite claims no longer active.

    Only after a reclassification the belief is made anew of the claims that are left: its value holds (supersede) or another
    replaces it and the contradiction stays open (contradict). Without any claim left, and for other causes, it is rejected.
    """
    active = active_claims(claims, segments).select(F.col("id").alias("claim_id"), F.lit(1).alias("live")).distinct()
    current = beliefs.where("valid_to is null and status in ('candidate', 'provisional', 'accepted')")
    cited = current.select(F.col("id").alias("belief_id"), F.col("object_text").alias("held"), "cardinality_class", F.posexplode(F.array_distinct("claim_ids")).alias("pos", "claim_id"))
    s = segments.select(F.col("id").alias("segment_id"), F.col("invalidated_at").isNotNull().alias("gone"), "is_active")
    known = claims.select(F.col("id").alias("claim_id"), "segment_id", F.struct("object_text").alias("object")).join(s, "segment_id", "left").drop("segment_id")
    rows = cited.join(active, "claim_id", "left").join(known, "claim_id", "left")
    lost = F.col("live").isNull()
    facts = rows.groupBy("belief_id", "held", "cardinality_class").agg(
        F.count(F.when(lost, 1)).alias("lost"), F.count("live").alias("kept"), F.bool_or(lost & F.col("gone")).alias("gone"), F.bool_or(lost & ~F.col("is_active") & ~F.col("gone")).alias("off"),
        F.min_by("object", F.when(~lost, F.col("pos")))["object_text"].alias("left_text"),
    ).where("lost > 0")
    same = F.col("cardinality_class").isin("multi_current", "event") | (normalize_subject(F.coalesce("held", F.lit(""))) == normalize_subject(F.coalesce("left_text", F.lit(""))))
    cause = F.when(F.col("gone"), "reclassified").when(F.col("off"), "deactivated").otherwise("reextraction")
    decision = F.when((cause != "reclassified") | (F.col("kept") == 0), "reject").when(same, "supersede").otherwise("contradict")
    return facts.select("belief_id", "lost", "kept", cause.alias("cause"), decision.alias("decision"))


def confidence_stats(claims: DataFrame, keys: list[str]) -> DataFrame:
    """mean, max, min, count and population deviation of confidence."""
    c = "confidence"
    return claims.groupBy(*keys).agg(F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), F.count(c).alias("n"), F.round(F.stddev_pop(c), 6).alias("stddev"))


def evidence_interval(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """id, first_us, last_us: the earliest and latest time among a claim's evidence, when written where that is an instant, else when delivered."""
    one = claims.select("id", F.explode(F.array_distinct("evidence_message_ids")).alias("m_id"))
    return one.join(export_times(claims, messages), "m_id").groupBy("id").agg(F.min("at").alias("first_us"), F.max("at").alias("last_us"))
