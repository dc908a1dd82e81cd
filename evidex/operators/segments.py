"""Deterministic segmentation: greedy windows and groups over ordered messages.

A greedy fold is order dependent, yet it need not run over a whole conversation
in one task. A block of messages is reduced to a small transfer table: for any
size already in the open segment, where the first break falls decides all the
rest of the block, and only the first messages up to the target can be that
break. The tables are chained per conversation, then every block assigns its
segments on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import embeddable, token_estimate
from evidex.session import stage

#: Positions per block.
BLOCK = 4096


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of a key in one partition, by a hash of its own.

    repartition() by the very keys of a join before it is left out of the plan, and where adaptive execution then turns that join into a
    broadcast, its shuffle is read as its writers left it.
    """
    return df.repartition(F.xxhash64(*keys))


def by_group(df: DataFrame, keys: list[str], order: list[str], one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one() applied to the ordered rows of each group, many groups per batch. Groups must be of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if b.empty:
                continue
            same = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            held, b = b[same], b[~same]
            if len(b):
                yield pd.concat([one(g) for _, g in b.groupby(keys, sort=False)], ignore_index=True)
        if held is not None and len(held):
            yield one(held)

    return together(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def breaks(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a segment that starts at each position: the next start, the size left open at the end (-1: none), and segments begun."""
    n = len(sizes)
    p = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.maximum(np.searchsorted(p, p[:-1] + target, side="right") - 1, np.arange(1, n + 1))
    left, begun = np.full(n, -1, dtype=np.int64), np.ones(n, dtype=np.int64)
    for j in range(n - 1, -1, -1):
        if nxt[j] >= n:
            left[j] = p[n] - p[j] if p[n] - p[j] <= target else -1
        else:
            left[j], begun[j] = left[nxt[j]], begun[nxt[j]] + 1
    return nxt, left, begun


def _assign(target: int):
    """Segments of rows ordered by (k, block, pos), one plain pass; state and before are what is open and begun before the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, segment = None, 0, 0
        for batch in batches:
            ks, blocks, sizes, states, befores = (batch.column(c).to_pylist() for c in ("k", "block", "size", "state", "before"))
            out = []
            for k, block, size, state, before in zip(ks, blocks, sizes, states, befores):
                if at != (k, block):
                    at, open_, segment = (k, block), state if state >= 0 else target + 1, before - 1
                if open_ + size > target:
                    segment, open_ = segment + 1, size
                else:
                    open_ += size
                out.append(segment)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("pos"), pa.array(out, pa.int64())], names=["k", "pos", "segment"])

    return run


def greedy(items: DataFrame, key: str, pos: str, size: str, target: int, block: int = BLOCK) -> DataFrame:
    """key, pos, segment: items packed in order into segments of at most target; a larger item is a segment of its own.

    items: key, pos (unique in a key, at least 0), size. Only keys of several blocks need transfer tables; all others are
    assigned in one pass after one shuffle.
    """
    rows = stage(items.select(F.col(key).alias("k"), F.col(pos).cast("long").alias("pos"), F.col(size).cast("long").alias("size")).withColumn("block", F.floor(F.col("pos") / block)), "items")
    kind = rows.schema["k"].dataType.simpleString()
    many = rows.groupBy("k").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("k")

    def table(g: pd.DataFrame) -> pd.DataFrame:
        sizes = g["size"].to_numpy()
        _, left, begun = breaks(sizes, target)
        p = np.concatenate([[0], np.cumsum(sizes)])
        first = np.flatnonzero(p[:-1] <= target)  # a break at j needs what came before it to have fitted
        return pd.DataFrame([(g["k"].iat[0], g["block"].iat[0], p[first + 1].tolist(), left[first].tolist(), begun[first].tolist(), int(p[-1]))], columns=["k", "block", "reach", "left", "begun", "total"])

    tables = by_group(rows.join(many, "k", "left_semi"), ["k", "block"], ["pos"], table, f"k {kind}, block long, reach array<long>, left array<long>, begun array<long>, total long")

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        state, segments, out = -1, 0, []
        for k, b, reach, left, begun, total in g.itertuples(index=False):
            out.append((k, b, state, segments))
            if state < 0:
                at = 0
            else:
                at = int(np.searchsorted(np.asarray(reach) + state, target, side="right"))
            if at < len(left):
                state, segments = int(left[at]), segments + int(begun[at])
            else:
                state += int(total)
        return pd.DataFrame(out, columns=["k", "block", "state", "before"])

    entries = tables.groupBy("k").applyInPandas(chain, f"k {kind}, block long, state long, before long")
    joined = rows.join(entries, ["k", "block"], "left").fillna({"state": -1, "before": 0})
    ready = together(joined, ["k", "block"]).sortWithinPartitions("k", "block", "pos")
    return ready.mapInArrow(_assign(target), f"k {kind}, pos long, segment long").select(F.col("k").alias(key), F.col("pos").alias(pos), "segment")


def previous(rows: DataFrame, key: str, pos: str, col: str, block: int = BLOCK) -> DataFrame:
    """rows with prev_<col> of the row before in the key; windows run in blocks, borders come from one row per block."""
    rows = rows.withColumn("block", F.floor(F.col(pos) / block))
    ends = rows.groupBy(key, "block").agg(F.max_by(F.struct(F.col(col).alias("v")), pos).alias("last"))
    ends = ends.select(F.col(key).alias("e_key"), F.col("block").alias("e_block"), F.lag("last").over(Window.partitionBy(key).orderBy("block"))["v"].alias("carried"))
    w = Window.partitionBy(key, "block").orderBy(pos)
    out = rows.join(ends, (F.col(key) == F.col("e_key")) & (F.col("block") == F.col("e_block")))
    return out.withColumn(f"prev_{col}", F.when(F.row_number().over(w) == 1, F.col("carried")).otherwise(F.lag(col).over(w))).drop("block", "e_key", "e_block", "carried")


def following(rows: DataFrame, key: str, pos: str, cols: list[str], block: int = BLOCK) -> DataFrame:
    """rows with next_<col> of the row after in the key, null for the last; blocks and borders as in previous()."""
    rows = rows.withColumn("block", F.floor(F.col(pos) / block))
    firsts = rows.groupBy(key, "block").agg(F.min_by(F.struct(*cols), pos).alias("first"))
    firsts = firsts.select(F.col(key).alias("e_key"), F.col("block").alias("e_block"), F.lead("first").over(Window.partitionBy(key).orderBy("block")).alias("carried"))
    w = Window.partitionBy(key, "block").orderBy(pos)
    out = rows.join(firsts, F.col(key).eqNullSafe(F.col("e_key")) & (F.col("block") == F.col("e_block"))).withColumn("after", F.coalesce(F.lead(F.struct(*cols)).over(w), "carried"))
    return out.select(*rows.columns, *(F.col("after")[c].alias(f"next_{c}") for c in cols)).drop("block")


def tokens_of(messages: DataFrame) -> Column:
    """Estimated tokens of a message: its column tokens where there is one, so that texts need not travel, else of content_text."""
    return F.col("tokens") if "tokens" in messages.columns else token_estimate(F.col("content_text"))


def fixed_windows(messages: DataFrame, target: int = 200) -> DataFrame:
    """conversation_id, sequence_index, segment: windows of at most target estimated tokens."""
    sized = messages.select("conversation_id", "sequence_index", tokens_of(messages).alias("size"))
    return greedy(sized, "conversation_id", "sequence_index", "size", target)


def message_groups(messages: DataFrame, target: int = 200) -> DataFrame:
    """conversation_id, sequence_index, segment: as fixed_windows, but a reply is never parted from the user message before it."""
    role = F.lower(F.coalesce("role", F.lit("")))
    rows = messages.select("conversation_id", "sequence_index", role.alias("role"), tokens_of(messages).alias("size"))
    rows = previous(stage(rows.withColumn("at", F.struct("role", "sequence_index")), "units"), "conversation_id", "sequence_index", "at")
    # a unit is named by its first message; only a reply looks one row back
    joins = F.coalesce((F.col("role") == "assistant") & (F.col("prev_at.role") == "user"), F.lit(False))
    unit = stage(rows.select("conversation_id", "sequence_index", "size", F.when(joins, F.col("prev_at.sequence_index")).otherwise(F.col("sequence_index")).alias("unit")), "units")
    packed = greedy(unit.groupBy("conversation_id", "unit").agg(F.sum("size").alias("size")), "conversation_id", "unit", "size", target)
    return unit.join(packed, ["conversation_id", "unit"]).select("conversation_id", "sequence_index", "segment")


def prompt_length(messages: DataFrame) -> Column:
    """Characters a message takes in a prompt; of a tool message only a short note counts."""
    tool = F.lower(F.coalesce("role", F.lit(""))) == "tool"
    n = F.when(tool, 60).otherwise(F.coalesce(F.length("content_text"), F.lit(0)))
    return n + F.length("id") + F.coalesce(F.length("role"), F.lit(0)) + 80


def windows_by_budget(messages: DataFrame, budget: int = 60_000) -> DataFrame:
    """conversation_id, sequence_index, window, truncated: windows whose prompt stays within a number of characters."""
    sized = messages.select("conversation_id", "sequence_index", prompt_length(messages).alias("size"))
    packed = greedy(sized.withColumn("size", F.least("size", F.lit(budget))), "conversation_id", "sequence_index", "size", budget)
    return packed.join(sized, ["conversation_id", "sequence_index"]).select("conversation_id", "sequence_index", F.col("segment").alias("window"), (F.col("size") > budget).alias("truncated"))


def split_windows(windows: DataFrame, failed: DataFrame) -> DataFrame:
    """windows (conversation_id, sequence_index, window) with part: of a window that failed (conversation_id, window) each message is a part of its own, else null."""
    f = failed.select(F.col("conversation_id").alias("__c"), F.col("window").alias("__w")).distinct()
    hit = windows["conversation_id"].eqNullSafe(F.col("__c")) & (windows["window"] == F.col("__w"))
    return windows.join(f, hit, "left").select(*windows.columns, F.when(F.col("__w").isNotNull(), F.col("sequence_index")).alias("part"))


def context_budget(configured: int, context_tokens: int) -> int:
    """The smaller of the configured characters and 60 % of the context at 2.5 characters a token; 4000 where that is none."""
    safe = int(context_tokens * 2.5 * 0.6)
    return min(configured, safe) if safe > 0 else 4000


def expand_spans(spans: DataFrame, messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """span_id, message_id, sequence_index: all messages between the lowest and highest member of each span (span_id, conversation_id, lo, hi).

    A range join as an equi-join: spans are cut at block borders.
    """
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    m = messages.select(F.col("conversation_id").alias("c"), F.col("id").alias("message_id"), "sequence_index", F.floor(F.col("sequence_index") / block).alias("b"))
    return cut.join(m, (F.col("conversation_id") == F.col("c")) & (F.col("block") == F.col("b")) & F.col("sequence_index").between(F.col("lo"), F.col("hi"))).select("span_id", "message_id", "sequence_index")


def segment_tier(segments: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """id, tier: the highest privacy tier of a segment's conversation and messages."""
    m = messages.groupBy("id").agg(F.max("privacy_tier").alias("m_tier")).withColumnRenamed("id", "m_id")
    own = segments.select("id", "conversation_id", F.explode_outer("message_ids").alias("m_id")).join(m, "m_id", "left").groupBy("id", "conversation_id").agg(F.max("m_tier").alias("m_tier"))
    c = conversations.groupBy(F.col("id").alias("conversation_id")).agg(F.max("privacy_tier").alias("c_tier"))
    return own.join(c, "conversation_id", "left").select("id", F.greatest("m_tier", "c_tier").alias("tier"))


def span_defects(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """id, defect of segments that are empty, name unknown messages or ones of another conversation, or are out of order."""
    one = segments.select("id", "conversation_id", F.posexplode_outer("message_ids").alias("at", "m_id"))
    m = messages.select(F.col("id").alias("m_id"), F.col("conversation_id").alias("m_conversation"), "sequence_index")
    rows = one.join(m, "m_id", "left")
    before = F.max("sequence_index").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a segment's messages are few
    rows = rows.withColumn("late", F.col("sequence_index") < before)
    facts = rows.groupBy("id").agg(
        F.count("at").alias("n"), F.max(F.col("at").isNotNull() & F.col("m_conversation").isNull()).alias("unknown"),
        F.max(F.coalesce(F.col("m_conversation") != F.col("conversation_id"), F.lit(False))).alias("foreign"), F.max(F.coalesce("late", F.lit(False))).alias("late"),
    )
    defect = F.when(F.col("n") == 0, "empty").when(F.col("unknown"), "unknown message").when(F.col("foreign"), "other conversation").when(F.col("late"), "out of order")
    return facts.select("id", defect.alias("defect")).where("defect is not null")


def build_segments(messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """conversation_id, segment, message_ids, content_text of assigned messages; tool messages and texts without content are not embedded."""
    rows = messages.join(assigned, ["conversation_id", "sequence_index"])
    text = F.when(F.lower(F.coalesce("role", F.lit(""))) == "tool", "").otherwise(embeddable(F.coalesce("content_text", F.lit(""))))
    item = F.struct("sequence_index", "id", text.alias("text"))
    g = rows.groupBy("conversation_id", "segment").agg(F.array_sort(F.collect_list(item)).alias("items"))  # a segment is of bounded size
    return g.select("conversation_id", "segment", F.col("items.id").alias("message_ids"), F.array_join(F.filter(F.col("items.text"), lambda t: t != ""), "\n\n").alias("content_text"))
