"""Relational building blocks: latest rows, pending rows, membership joins, snapshot differences, idempotent sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which null equals null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order should end with a unique column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_by_max(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest values of order, combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work without a row of done for the same keys; null equals null."""
    return work.join(done, null_safe(work, done, keys), "left_anti")


def answered(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work with a row of done for the same keys; null equals null."""
    return work.join(done, null_safe(work, done, keys), "left_semi")


def complete(parents: DataFrame, children: DataFrame, done: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents all of whose children are in done (relational division); a parent without children is complete."""
    missing = children.join(done.select(child).distinct(), child, "left_anti").select(parent)
    return parents.join(missing, parent, "left_anti")


def members(df: DataFrame, array: str, other: DataFrame, other_key: str, keep: list[str]) -> DataFrame:
    """df joined with other on membership of other_key in an array column: exploded first, then an equi-join."""
    one = df.select(*keep, F.explode(F.array_distinct(F.col(array))).alias("__member"))
    return one.join(other, F.col("__member") == other[other_key]).drop("__member")


def either_end(links: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """(node, keep...) once per link and distinct end, for joins on either end without an OR."""
    return links.select(F.explode(F.array_distinct(F.array(a, b))).alias("node"), *keep)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, action: insert, noop, supersede or tombstone, by comparing content hashes of two snapshots."""
    o = old.select(F.col(key), F.col(digest).alias("old_hash"), F.lit(True).alias("was"))
    n = new.select(F.col(key), F.col(digest).alias("new_hash"), F.lit(True).alias("now"))
    action = (
        F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "tombstone")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "noop").otherwise("supersede")
    )
    return o.join(n, key, "full").select(key, action.alias("action"), "old_hash", "new_hash")


def apply_diff(history: DataFrame, diff: DataFrame, key: str, at: Column) -> DataFrame:
    """A history (key, hash, valid_from, valid_to) after a snapshot: changed rows are closed at the time, new ones opened."""
    closing = diff.where(F.col("action").isin("supersede", "tombstone")).select(F.col(key).alias("__k"))
    kept = history.join(closing, history[key] == F.col("__k"), "left").withColumn(
        "valid_to", F.when(F.col("__k").isNotNull() & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))
    ).drop("__k")
    opened = diff.where(F.col("action").isin("insert", "supersede")).select(key, F.col("new_hash").alias("hash"), at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return kept.unionByName(opened)


def insert_once(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one per key, none whose key exists."""
    return rows.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def conflicts(existing: DataFrame, rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys that occur with more than one content hash among existing and new rows."""
    both = existing.select(*keys, digest).unionByName(rows.select(*keys, digest))
    return both.groupBy(*keys).agg(F.count_distinct(digest).alias("hashes")).where("hashes > 1")


def upsert_progress(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Progress rows (keys, status, error_count, updated_at) after new reports: the latest status, errors added up."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(
        F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.sum("error_count").alias("error_count"), F.max("updated_at").alias("updated_at")
    )


def above_watermark(events: DataFrame, marks: DataFrame, scope: str, time: str) -> DataFrame:
    """Scopes whose latest event is after their mark (or that have none): scope, newest, mark."""
    newest = events.groupBy(scope).agg(F.max(time).alias("newest"))
    return newest.join(marks.select(scope, "mark"), scope, "left").where(F.col("mark").isNull() | (F.col("newest") > F.col("mark")))


def distribution_l1(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """l1: distance of the two normalised distributions of key; 0 if both are empty, null if one is."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("<none>")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("k", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # one row per value

    both = shares(a, "pa").join(shares(b, "pb"), "k", "full")
    s = both.agg(F.count("pa").alias("na"), F.count("pb").alias("nb"), F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))).alias("d"))
    return s.select(F.when((F.col("na") == 0) & (F.col("nb") == 0), 0.0).when((F.col("na") > 0) & (F.col("nb") > 0), F.round("d", 9)).alias("l1"))


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows chosen by the hash of seed and key: the same rows whatever the layout."""
    return df.withColumn("draw", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256)).orderBy("draw", key).limit(n).drop("draw")


def round_robin(df: DataFrame, bucket: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows taken from the buckets in turn, inside a bucket by the hash of seed and key."""
    draw = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256)
    turn = F.row_number().over(Window.partitionBy(*bucket).orderBy(draw, key))
    # no bucket gives more than n rows, so the window keeps a group limit of n per bucket
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *bucket, key).limit(n)


def secure_view(df: DataFrame, allowed: list[tuple[str, str]], ceiling: int | None = None) -> DataFrame:
    """Rows of the allowed (tenant_id, corpus_id) pairs up to a privacy tier. Raises without any pair."""
    if not allowed:
        raise PermissionError("no tenant and corpus allowed")
    pair = F.struct("tenant_id", "corpus_id").isin([F.struct(F.lit(t), F.lit(c)) for t, c in allowed])
    return df.where(pair) if ceiling is None else df.where(pair & (F.col("privacy_tier") <= ceiling))


def in_list_order(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows whose key is in ids, with their position; to be ordered by it."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), "position int, __id string")
    return df.join(wanted, F.col(key) == F.col("__id")).drop("__id")
