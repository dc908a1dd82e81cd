"""P5: rebuilding conversations from message rows.

The kept deliveries are a stream. Keyed state gathers them per conversation and
block of sequence numbers inside an event-time session; a watermark closes the
session when nothing more arrived for the timeout, rows out of order are
buffered until then, and the closed blocks are emitted. A block's state is a set
of (sequence_index, speaker, visible), so it is bounded by the block length
whatever the number of rows, and one huge conversation spreads over many tasks.
A row that comes after its conversation was closed opens a new session of its
block; a verdict is folded from all that was emitted for the conversation, so
the late row corrects it. What is still open when the feed ends so far is
judged by the rows there are.

Edge cases: a null conversation_id belongs to no conversation and is left out;
null, unknown or blank roles name no speaker; content is visible if any
character is neither white space, control nor format character; conversations
without messages are empty; a null imported_at counts as the start of 1970;
extra columns are ignored; an empty table gives no rows. Rows behind the
watermark by more than the delay end the run with an error; none is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.deliveries import first_of_each
from evidex.session import scratch_path, stage

#: How long a conversation stays open after its last message, and how far rows may be out of order in the feed.
TIMEOUT, DELAY = "60 days", "0 seconds"
#: Runs of the stream a stored feed is played in, in the order of imported_at.
SPANS = 3
#: Sequence numbers per unit of state.
BLOCK = 1024
# Words of the exporting products for the speakers.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "system": "system", "tool": "tool"}
#: State is kept on disk; all stores of an executor share one bounded cache.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}
#: Time of a message without imported_at: sessions drop nulls.
NO_TIME = "1970-01-01 00:00:00"
_BLOCK = "conversation_id string, block int, ended timestamp, items array<struct<seq: int, speaker: string, visible: boolean>>, numbered bigint, messages bigint, spoken bigint, visible boolean"


def speaker(role: Column) -> Column:
    """The speaker a role names, else null."""
    word = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))[word]


def visible(content: Column) -> Column:
    """Whether the text has a visible character."""
    return F.coalesce(content.rlike(r"[^\p{Z}\p{C}]"), F.lit(False))


def feed_of(messages: DataFrame, deduplicate: bool = False) -> DataFrame:
    """What the state needs of each message, and its id; on request only of the first delivery of each message."""
    by = ["source_id", "external_id"] if deduplicate else []
    small = messages.select(
        "id", *by, "imported_at", "conversation_id", F.col("sequence_index").cast("int").alias("seq"), speaker(F.col("role")).alias("speaker"), visible(F.col("content_text")).alias("visible")
    )
    kept = (first_of_each(small) if deduplicate else small).where(F.col("conversation_id").isNotNull())
    return kept.select("id", "conversation_id", "seq", "speaker", "visible", F.coalesce(F.col("imported_at").cast("timestamp"), F.to_timestamp(F.lit(NO_TIME))).alias("event_time"))


def _block() -> Column:
    return F.coalesce(F.floor(F.col("seq") / BLOCK).cast("int"), F.lit(-1)).alias("block")


def _gathered() -> list[Column]:
    item = F.when(F.col("seq").isNotNull(), F.struct("seq", "speaker", "visible"))
    return [F.collect_set(item).alias("items"), F.count("seq").alias("numbered"), F.count(F.lit(1)).alias("messages"), F.count("speaker").alias("spoken"), F.max("visible").alias("visible")]


def close_blocks(stream: DataFrame, timeout: str = TIMEOUT, delay: str = DELAY) -> DataFrame:
    """The streaming operator: one row per closed session of each (conversation_id, block) of a feed_of() stream."""
    sessions = stream.withWatermark("event_time", delay).groupBy("conversation_id", _block(), F.session_window("event_time", timeout).alias("span")).agg(*_gathered())
    return sessions.select("conversation_id", "block", F.col("span.end").alias("ended"), "items", "numbered", "messages", "spoken", "visible")


def _shrunk(turns: Column) -> Column:
    """A string of u (user), a (visible reply), e (invisible reply) with runs merged and answered interior turns removed; X: an unanswered run."""
    turns = F.regexp_replace(turns, "u+", "u")
    turns = F.regexp_replace(turns, "[ae]*a[ae]*", "a")
    turns = F.regexp_replace(turns, "e+", "e")
    turns = F.regexp_replace(turns, "a(?:ua)+", "a")
    return F.when(turns.rlike("X|ueu"), F.lit("X")).otherwise(turns)


def play(stream: DataFrame, home: str, timeout: str = TIMEOUT, delay: str = DELAY) -> None:
    """Run close_blocks over what stream has new since the last call, and append the blocks closed by it to home/out."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            close_blocks(stream, timeout, delay)
            .writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{home}/state").start(f"{home}/out")
        )
        query.awaitTermination()
        late = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        if late:
            raise ValueError(f"{late} rows came behind the watermark; the delay of {delay} is too small for this feed")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def play_feed(feed: DataFrame, timeout: str = TIMEOUT, spans: int = SPANS, files_per_trigger: int | None = None, delay: str = DELAY) -> DataFrame:
    """The blocks that close while a stored feed is played span by span of event_time, each span a run of the stream."""
    spark = feed.sparkSession
    home = scratch_path(spark, "feed")
    at = F.unix_micros("event_time").alias("at")
    parts = [k / spans for k in range(1, spans)]
    cuts = sorted(set(feed.where(F.col("event_time") > F.to_timestamp(F.lit(NO_TIME))).select(at).approxQuantile("at", parts, 0.02))) if parts else []
    bound = lambda us: F.timestamp_micros(F.lit(int(us)))
    reader = spark.readStream.schema(feed.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if lo is None else F.col("event_time") > bound(lo)
        inside = inside if hi is None else inside & (F.col("event_time") <= bound(hi))
        feed.where(inside).write.mode("append").parquet(f"{home}/in")
        play(reader.parquet(f"{home}/in"), home, timeout, delay)
    return spark.read.schema(_BLOCK).parquet(f"{home}/out")


def open_blocks(feed: DataFrame, closed: DataFrame) -> DataFrame:
    """The sessions of feed that no closed block holds: what the state still buffers when the feed ends so far."""
    ends = closed.groupBy("conversation_id", "block").agg(F.max("ended").alias("ended"))
    rows = feed.withColumn("block", _block()).join(ends, ["conversation_id", "block"], "left").where(F.col("ended").isNull() | (F.col("event_time") >= F.col("ended")))
    return rows.groupBy("conversation_id", "block").agg(F.max("event_time").alias("ended"), *_gathered())


def run_feed(feed: DataFrame, timeout: str = TIMEOUT, files_per_trigger: int | None = None, spans: int = SPANS) -> DataFrame:
    """All sessions of all blocks of a stored feed, those the stream closed and those still open at its end."""
    closed = play_feed(feed, timeout, spans, files_per_trigger)
    return closed.unionByName(open_blocks(feed, closed))


def fold_blocks(sessions: DataFrame) -> DataFrame:
    """One row per conversation: visible, sound (numbering and roles), answered, lo (its lowest sequence_index).

    The sessions of one block are put together first: a number that two of them hold is used twice.
    """
    blocks = sessions.groupBy("conversation_id", "block").agg(
        F.flatten(F.collect_list("items")).alias("items"), *(F.sum(c).alias(c) for c in ("numbered", "messages", "spoken")), F.max("visible").alias("visible")
    )
    seqs = F.transform("items", lambda x: x["seq"])
    code = F.transform(
        F.filter(F.array_sort("items"), lambda x: x["speaker"].isin("user", "assistant")),
        lambda x: F.when(x["speaker"] == "user", "u").when(x["visible"], "a").otherwise("e"),
    )
    small = blocks.select(
        "conversation_id", "block", F.array_min(seqs).alias("lo"), F.array_max(seqs).alias("hi"), "numbered", "messages", "spoken", "visible",
        F.size(F.array_distinct(seqs)).alias("distinct"), _shrunk(F.array_join(code, "")).alias("turns"),
    )
    return (
        small.groupBy("conversation_id")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("numbered").alias("numbered"), F.sum("messages").alias("messages"),
            F.sum("spoken").alias("spoken"), F.sum("distinct").alias("distinct"), F.max("visible").alias("visible"),
            _shrunk(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "turns"))), lambda x: x["turns"]), "")).alias("turns"),
        )
        .select(
            "conversation_id", "lo", "visible",
            ((F.col("numbered") == F.col("messages")) & (F.col("spoken") == F.col("messages")) & (F.col("distinct") == F.col("numbered")) & (F.col("hi") - F.col("lo") + 1 == F.col("distinct"))).alias("sound"),
            (~F.col("turns").rlike("X|ue?$")).alias("answered"),
        )
    )


def verdicts(messages: DataFrame, conversations: DataFrame, deliveries: DataFrame | None = None, feed: DataFrame | None = None, timeout: str = TIMEOUT, spans: int = SPANS) -> DataFrame:
    """conversation_id, lo, defect (null: whole) of every conversation of conversations or deliveries.

    messages are the kept deliveries, or feed is what feed_of() makes of them, stored; deliveries (by default messages) name
    the conversations to judge.
    """
    feed = stage(feed_of(messages), "kept") if feed is None else feed
    judged = fold_blocks(run_feed(feed, timeout, spans=spans))
    headers = conversations.where(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id")).distinct().withColumn("header", F.lit(True))
    named = (deliveries if deliveries is not None else messages).where(F.col("conversation_id").isNotNull()).select("conversation_id").distinct()
    every = headers.join(named, "conversation_id", "full").join(judged, "conversation_id", "left")
    defect = (
        F.when(~F.coalesce("visible", F.lit(False)), "empty")
        .when(F.col("header").isNull() | ~F.coalesce("sound", F.lit(False)), "broken")
        .when(~F.col("answered"), "unanswered")
    )
    return every.select("conversation_id", "lo", defect.alias("defect"))


def dialogues(messages: DataFrame, judged: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """conversation_id, turn (from 0, without gaps), speaker, content_text of every whole conversation.

    In a whole conversation the numbering has no gap, so a turn is its distance from the lowest number; nothing is sorted or
    collected. The turns are settled on the small feed; the texts are joined once.
    """
    feed = feed_of(messages) if feed is None else feed
    whole = judged.where(F.col("defect").isNull()).select("conversation_id", "lo")
    turns = feed.join(whole, "conversation_id").select(F.col("id").alias("__id"), "conversation_id", (F.col("seq") - F.col("lo")).alias("turn"), "speaker")
    texts = messages.select(F.col("id").alias("__text_id"), "content_text")
    return turns.join(texts, F.col("__id") == F.col("__text_id")).select("conversation_id", "turn", "speaker", "content_text")
