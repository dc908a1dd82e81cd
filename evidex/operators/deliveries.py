"""P2: messages delivered more than once.

Identifiers of the form ``producer:number`` are producer sequences. Per source
and producer the numbers seen so far are kept as disjoint ranges; a delivery
whose number no range covers is accepted once and the ranges are merged. All
other identifiers are resolved by exact keyed lookup.

Edge cases: a null identifier or source is never a duplicate. Blank
identifiers of one source agree with each other (they are not null). Equal
imported_at is decided by the smallest id. An empty input gives empty results.
Extra columns pass through; helper columns start with ``__`` so that they
cannot clash with the input's.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.times import epoch_us
from evidex.session import stage

#: Canonical decimal numbers only, so that equal numbers mean equal strings.
SEQUENCE = r"^(.*[^0-9].*|[^0-9]):(0|[1-9][0-9]{0,16})$"
#: Numbers of a producer are handled in blocks, so that one producer spreads over many tasks.
BLOCK = 4096


def identity(external_id: Column) -> Column:
    """The identifier without surrounding white space and regardless of case."""
    return F.lower(F.regexp_replace(external_id, r"(?U)^\s+|\s+$", ""))


@dataclass
class SeenState:
    """What earlier deliveries left: ranges (source_id, producer, lo, hi) and keys (source_id, key)."""

    ranges: DataFrame
    keys: DataFrame


def _keyed(messages: DataFrame) -> DataFrame:
    key = identity(F.col("external_id"))
    return messages.select("id", "source_id", "imported_at", key.alias("key")).where(F.col("key").isNotNull() & F.col("source_id").isNotNull())


def _first_deliveries(rows: DataFrame) -> DataFrame:
    """source_id, key, deliveries, kept_id (of the first delivery), producer, number of each key; combined before the shuffle.

    Only canonical numbers make a sequence, so equal numbers of a producer mean equal keys.
    """
    firsts = rows.groupBy("source_id", "key").agg(F.min(F.struct("imported_at", "id")).alias("first"), F.count(F.lit(1)).alias("deliveries"))
    producer = F.nullif(F.regexp_extract("key", SEQUENCE, 1), F.lit(""))
    firsts = firsts.select("source_id", "key", "deliveries", F.col("first.id").alias("kept_id"), producer.alias("producer"))
    return firsts.withColumn("number", F.when(F.col("producer").isNotNull(), F.regexp_extract("key", SEQUENCE, 2).cast("long")))


def merge_ranges(numbers: DataFrame) -> DataFrame:
    """Disjoint ranges (source_id, producer, lo, hi) covering the given ranges.

    numbers has the columns source_id, producer, lo, hi. Ranges are cut at block borders and merged within blocks of the
    number line, then within blocks of blocks, then over the whole line. To each wider step only those go on that reach a
    border of their block, so a task holds at most two ranges per block however many numbers a producer has.
    """
    def islands(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("lo", "hi")
        reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("fresh", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
        return (
            marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "island")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .drop("island")
        )

    block = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))
    rows = numbers.select("source_id", "producer", "lo", "hi", block.alias("block"))
    rows = rows.withColumns({"lo": F.greatest("lo", F.col("block") * BLOCK), "hi": F.least("hi", F.col("block") * BLOCK + (BLOCK - 1))})
    done = None
    for size in (BLOCK, BLOCK * BLOCK):
        rows = islands(rows.withColumn("block", F.floor(F.col("lo") / size)), ["source_id", "producer", "block"])
        touching = (F.col("lo") == F.col("block") * size) | (F.col("hi") == F.col("block") * size + (size - 1))
        inner = rows.where(~touching).drop("block")
        done = inner if done is None else done.unionByName(inner)
        rows = rows.where(touching).drop("block")
    return done.unionByName(islands(rows, ["source_id", "producer"]))


def _seen(firsts: DataFrame, seen: SeenState) -> DataFrame:
    """firsts with known: whether a range of the producer covers the number, or else an earlier key is the same.

    Ranges are cut at block borders, so that they are met in an equi-join.
    """
    cut = seen.ranges.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)))
    ).select(F.col("source_id").alias("s"), F.col("producer").alias("p"), F.col("block").alias("b"), "lo", "hi")
    on = (F.col("source_id") == F.col("s")) & (F.col("producer") == F.col("p")) & (F.floor(F.col("number") / BLOCK) == F.col("b"))
    numbered = firsts.where("producer is not null").join(cut, on & F.col("number").between(F.col("lo"), F.col("hi")), "left")
    keys = seen.keys.select("source_id", "key", F.lit(True).alias("there"))
    named = firsts.where("producer is null").join(keys, ["source_id", "key"], "left")
    return numbered.select(firsts.columns + [F.col("lo").isNotNull().alias("known")]).unionByName(named.select(firsts.columns + [F.col("there").isNotNull().alias("known")]))


def deliver(messages: DataFrame, seen: SeenState | None = None, new_keys_only: bool = False) -> tuple[DataFrame, SeenState]:
    """The surplus deliveries of messages given earlier state, and the state after them.

    messages: id, source_id, external_id, imported_at. Returns ((message_id, kept_id),
    state); kept_id is null where an earlier batch already delivered the message. On request the state's keys are only
    those this batch adds.
    """
    return _deliver(_keyed(messages), seen, new_keys_only)


def _deliver(rows: DataFrame, seen: SeenState | None, new_keys_only: bool) -> tuple[DataFrame, SeenState]:
    """deliver() on _keyed() rows. The first deliveries are worked out once and stored."""
    firsts = _first_deliveries(rows)
    firsts = stage(_seen(firsts, seen) if seen else firsts.withColumn("known", F.lit(False)), "firsts")
    again = firsts.where("known or deliveries > 1").select("source_id", "key", F.when(~F.col("known"), F.col("kept_id")).alias("kept_id"), "known")
    out = rows.join(again, ["source_id", "key"]).where(F.col("known") | ~F.col("id").eqNullSafe(F.col("kept_id"))).select(F.col("id").alias("message_id"), "kept_id")
    fresh = firsts.where("not known")
    new = fresh.where("producer is not null").select("source_id", "producer", F.col("number").alias("lo"), F.col("number").alias("hi"))
    names = fresh.where("producer is null").select("source_id", "key")
    if seen:
        new = seen.ranges.unionByName(new)
        names = names if new_keys_only else seen.keys.unionByName(names)
    return out, SeenState(merge_ranges(new), names)


def deliver_in_order(messages: DataFrame, epochs: int = 4) -> tuple[DataFrame, SeenState]:
    """deliver() for the deliveries of successive spans of imported_at, each against the ranges and keys of those before.

    Rows of one imported_at are in one span. Keys are those of the stored first deliveries, ranges are merged and written anew after each span.
    """
    messages = stage(_keyed(messages), "keyed")  # each span reads it several times
    at = epoch_us("imported_at")
    parts = [k / epochs for k in range(1, epochs)]
    cuts = sorted(set(messages.where("imported_at is not null").select(at.alias("at")).approxQuantile("at", parts, 0.01))) if parts else []
    bound = lambda us: F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=int(us))}'")  # noqa: E731 - a literal, so that scans skip row groups
    when, out, state, keys = F.col("imported_at"), None, None, None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if lo is None else when > bound(lo)
        if hi is not None:
            inside = inside & (when <= bound(hi))
        if lo is None:
            inside = inside | when.isNull()  # rows without a time count as the earliest
        surplus, after = _deliver(messages.where(inside), state, new_keys_only=True)
        out = surplus if out is None else out.unionByName(surplus)
        keys = after.keys if keys is None else keys.unionByName(after.keys)
        state = SeenState(stage(after.ranges, "ranges"), keys)
    return out, state


def surplus_deliveries(messages: DataFrame) -> DataFrame:
    """message_id of every delivery but the first of each message."""
    return deliver(messages)[0].select("message_id")


def first_deliveries(messages: DataFrame) -> DataFrame:
    """messages without the surplus deliveries; rows without an identifier all stay."""
    gone = surplus_deliveries(messages).withColumnRenamed("message_id", "__gone")
    return messages.join(gone, messages["id"] == gone["__gone"], "left_anti")


def first_of_each(rows: DataFrame) -> DataFrame:
    """rows without the surplus deliveries, in one aggregation: the first of each message carries its other columns along.

    rows: id, source_id, external_id, imported_at and a few small columns, which may have any name but __key. This is
    deliver() without earlier state, where no range covers anything yet; for wide rows first_deliveries() joins instead.
    """
    others = [c for c in rows.columns if c not in ("imported_at", "id", "source_id")]
    keyed = rows.withColumn("__key", identity(F.col("external_id")))
    known = F.col("__key").isNotNull() & F.col("source_id").isNotNull()
    first = keyed.where(known).groupBy("source_id", "__key").agg(F.min(F.struct("imported_at", "id", *others)).alias("__first"))
    return first.select("source_id", "__first.*").select(rows.columns).unionByName(keyed.where(~known).select(rows.columns))
