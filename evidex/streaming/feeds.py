"""Incremental twins of the batch operators, on Structured Streaming.

Each keeps its state as tables that a micro-batch replaces or extends, so a lost
executor costs a recomputation and a restarted query continues where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evidex.operators.deliveries import SeenState, deliver
from evidex.operators.timestamps import TimestampDictionary


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def _exists(spark: SparkSession, path: str) -> bool:
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    return home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home)


def dedupe(stream: DataFrame, home: str) -> StreamingQuery:
    """Append the first delivery of each message of a stream to home/kept.

    Batch n writes the ranges seen so far to home/ranges/n and appends only its own new keys as home/keys/batch=n, so what a
    batch writes grows with the batch and not with the stream. A repeated batch reads what was there before it and writes the
    same again.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        ranges, keys = f"{home}/ranges/{n - 1}", f"{home}/keys"
        seen = None
        if n and _exists(spark, ranges):
            known = spark.read.schema("source_id string, key string, batch int").parquet(keys).where(F.col("batch") < n)
            seen = SeenState(spark.read.parquet(ranges), known.select("source_id", "key"))
        surplus, state = deliver(batch, seen, new_keys_only=True)
        gone = surplus.select(F.col("message_id").alias("gone_id"))
        batch.join(gone, batch["id"] == gone["gone_id"], "left_anti").write.mode("overwrite").parquet(f"{home}/kept/batch={n}")
        state.keys.write.mode("overwrite").parquet(f"{keys}/batch={n}")
        state.ranges.write.mode("overwrite").parquet(f"{home}/ranges/{n}")
        batch.unpersist()

    return _start(stream, f"{home}/checkpoint", each)


def normalise(stream: DataFrame, home: str) -> StreamingQuery:
    """Append rows (raw, zone, locale and others) with utc_us to home/rows; only raw values not yet in home/dictionary are parsed."""
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        entries = TimestampDictionary(spark, f"{home}/dictionary")
        entries.extend(batch)
        entries.resolve(batch).write.mode("overwrite").parquet(f"{home}/rows/batch={n}")
        batch.unpersist()

    return _start(stream, f"{home}/checkpoint", each)


#: Batches after which the parts of a keyed state are put together.
COMPACT = 16


def current_state(spark: SparkSession, home: str, keys: list[str], order: list[str], schema: str | StructType, batch: int) -> DataFrame:
    """The state of latest_state() after a batch: the latest row of each key over the parts since the last compaction."""
    from evidex.operators.relational import latest_by_max

    since = batch // COMPACT * COMPACT
    parts = [f"{home}/state/{n}" for n in range(since, batch + 1) if _exists(spark, f"{home}/state/{n}")]
    rows = spark.read.schema(schema).parquet(*parts)
    return latest_by_max(rows, keys, order).select(rows.columns)


def latest_state(stream: DataFrame, home: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keyed state with one active row per key: batch n appends the latest row of each of its keys as home/state/n.

    Every COMPACT batches all parts since the last time are put together, so that a read (current_state()) touches few; what
    other batches write grows with the batch and not with the state. A repeated batch writes the same again.
    """
    from evidex.operators.relational import latest_by_max

    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        rows = batch
        if n and n % COMPACT == 0:
            rows = rows.unionByName(current_state(spark, home, keys, order, batch.schema, n - 1))
        latest_by_max(rows, keys, order).select(batch.columns).write.mode("overwrite").parquet(f"{home}/state/{n}")

    return _start(stream, f"{home}/checkpoint", each)


def tumbling(stream: DataFrame, time: str, keys: list[str], value: str, width: str, delay: str) -> DataFrame:
    """start, keys, n, total per window, emitted when the watermark has passed it; later rows are dropped."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
    )


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, delay: str) -> DataFrame:
    """keys, started, ended, n per session, emitted when the watermark has passed its end."""
    return stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
