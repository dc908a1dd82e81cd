"""P9: mixing sources to target weights.

Systematic sampling: each document of a source is expected to be used as often
as the source's target size divided by its size. The expected copies are summed
up along the source's documents ordered by size, one random offset per source is
added, and a document is emitted once per integer boundary its sum crosses. So
no document is used more often than the cap, and a source's size is hit to
within about one document.

The running sums are made in slices of bounded size that follow the order; what
lies before a slice comes from one row per slice and source, so a source that
holds most documents spreads over many tasks.

Edge cases: sources are compared without surrounding white space and regardless
of case; documents without a source, or of a source without target, are left
out; a source that is absent or too small for its share is used as far as its
cap allows and reported, and the others keep their proportions; at even_total() no
source that is there is too small; null texts are no documents, empty ones have size 0 and
are not used; an empty table gives shares of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import stage


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source_key, target_share, max_repeats, documents, available, wanted, copies_each of every target.

    total is the size to reach, by default that of all documents of the targets' sources.
    """
    have = sizes.where("n_tokens > 0").groupBy(source_key(F.col("source")).alias("source_key")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available"))
    t = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source_key")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    both = t.join(have, "source_key", "left").fillna(0, ["documents", "available"])
    size = F.lit(float(total)) if total is not None else F.sum("available").over(Window.partitionBy())  # one row per source
    return both.withColumn("wanted", F.col("target_share") * size).withColumn(
        "copies_each", F.when(F.col("available") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("available"))).otherwise(0.0)
    )


def even_total(sizes: DataFrame, targets: DataFrame) -> int:
    """The largest total at which every source that is there reaches its share within its cap; 0 without any."""
    room = plan(sizes, targets).where("available > 0 and target_share > 0").select((F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("room"))
    return int(room.agg(F.min("room")).first()[0] or 0)  # one row


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source_key, n_tokens, copies) of the documents used, (a report of each target)).

    sizes: doc_id, source, n_tokens. targets: source, target_share, max_repeats (a few rows).
    """
    spark = sizes.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = stage(plan(sizes, targets, total), "plan")
    rows = sizes.where("n_tokens > 0").select("doc_id", source_key(F.col("source")).alias("source_key"), "n_tokens")
    rows = rows.join(wanted.select("source_key", "copies_each"), "source_key").where("copies_each > 0")
    rows = stage(rows.repartitionByRange(n, "source_key", "n_tokens", "doc_id").withColumn("slice", F.spark_partition_id()), "slices")
    heads = rows.groupBy("slice", "source_key").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("slice", "source_key", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("slice", "source_key").orderBy("n_tokens", "doc_id")) + F.col("before")
    offset = F.pmod(F.xxhash64("source_key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    used = (
        rows.join(heads, ["slice", "source_key"])
        .withColumn("rank", rank)
        .withColumn("copies", (F.floor(F.col("rank") * F.col("copies_each") + offset) - F.floor((F.col("rank") - 1) * F.col("copies_each") + offset)).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source_key", "n_tokens", "copies")
    )
    used = stage(used, "mixed")
    got = used.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    report = wanted.join(got, "source_key", "left").fillna(0, ["tokens", "copies", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    report = report.select(
        F.col("source_key").alias("source"), "target_share", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6).alias("actual_share"),
        "documents", "available", F.round("wanted", 1).alias("wanted"), "tokens", "copies", "most_repeats", "max_repeats",
        (F.col("wanted") > F.col("available") * F.col("max_repeats")).alias("too_small"),
    )
    return used, report
