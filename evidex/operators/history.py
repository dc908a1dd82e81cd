"""P7: history of changing entity attributes.

Attributes are split by change rate into insert-only satellites: object_text,
status, and the reported end. A satellite gets a row only when the hash of its
attribute differs from the one before. End dates are computed in a lead-based
view over the satellites.

Keys may be hot, so nothing is windowed over a whole key. States are laid out
by range of (key, effect time) in slices of bounded size; windows run inside
(slice, key), and what crosses a slice border travels as one summary row per
slice and key. The states, the satellites' rows and the versions are written to
the shared folder once each; nothing else is.

Edge cases: key columns may be null (null is a key value of its own); a row
without valid_from and observed_at has no place in time and is left out; a
state that ends at or before its start makes no version but still ends the one
before; a first row with a null attribute leaves it null; repeated rows count
once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.times import epoch_us
from evidex.session import stage

KEY = ["subject_normalized", "predicate", "group_object_key"]
DEAD = ("rejected", "superseded")
SATELLITES = {"slow": ["object_text"], "fast": ["status"], "ends": ["valid_to"]}


def effective_states(beliefs: DataFrame) -> DataFrame:
    """One row per key and effect time: the latest recorded, then the largest id. Combined before the shuffle."""
    eff = epoch_us(F.coalesce("valid_from", "observed_at"))
    state = F.struct("recorded_at", "id", "object_text", "status", epoch_us("valid_to").alias("valid_to"))
    return (
        beliefs.select(*KEY, eff.alias("eff"), state.alias("state"))
        .where(F.col("eff").isNotNull())
        .groupBy(*KEY, "eff")
        .agg(F.max("state").alias("state"))
        .select(*KEY, "eff", "state.object_text", "state.status", "state.valid_to")
    )


def sliced(states: DataFrame, slices: int | None = None) -> DataFrame:
    """states with the number of their slice, contiguous in (key, eff), as a table in the shared folder."""
    n = slices or int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(states.repartitionByRange(n, *KEY, "eff").withColumn("slice", F.spark_partition_id()), "states")



def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"k_{k}"]) for k in KEY], a["slice"] == b["k_slice"])


def _neighbours(rows: DataFrame, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, stored: bool = False) -> DataFrame:
    """rows with columns of what the slices before (last) or after (first) hold of the same key.

    last and first are aggregates over (slice, key); of several slices the nearest non-null value counts.
    Only keys that cross a border have a summary that is joined: fewer than slices x 2 rows.
    rows is read twice, so it is written to the shared folder first unless it is stored already.
    """
    rows = rows if stored else stage(rows, "history")
    aggs = {**(last or {}), **(first or {})}
    w = Window.partitionBy(*KEY).orderBy("slice")
    summary = rows.groupBy("slice", *KEY).agg(*(v.alias(k) for k, v in aggs.items()))
    cols = [F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(k) for k in last or {}]
    cols += [F.first(k, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(k) for k in first or {}]
    summary = summary.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).select(
        F.col("slice").alias("k_slice"), *(F.col(k).alias(f"k_{k}") for k in KEY), "parts", *cols
    ).where("parts > 1")
    return rows.join(summary, _same_key(rows, summary), "left").drop("k_slice", "parts", *(f"k_{k}" for k in KEY))


def _in_slice() -> tuple:
    w = Window.partitionBy("slice", *KEY).orderBy("eff")
    return w, w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)


def filled(states: DataFrame) -> DataFrame:
    """sliced() states with null object_text or status replaced by the one before, and carried: the row before the slice, if any."""
    _, past, _ = _in_slice()
    last = {f"p_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("eff"))) for c in ("object_text", "status")}
    rows = _neighbours(states, last={**last, "p_row": F.max_by(F.struct("eff", "valid_to"), "eff")}, stored=True)
    rows = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past), f"p_{c}") for c in ("object_text", "status")})
    carried = F.struct(F.col("p_object_text").alias("object_text"), F.col("p_status").alias("status"), F.col("p_row.valid_to").alias("valid_to"), F.col("p_row.eff").alias("eff"))
    return rows.withColumn("carried", carried).drop("p_object_text", "p_status", "p_row")


def _hash(columns: list[Column]) -> Column:
    """Comparison folds white space and case."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")))
    return F.sha2(F.concat_ws("|", *(F.coalesce(fold(c), F.lit("\u0000")) for c in columns)), 256)


def changes(states: DataFrame) -> DataFrame:
    """slice, key, eff and of every satellite a struct of hash_diff and attributes where its hash differs from the one before, else null.

    states must be filled(). Rows without any change are left out; the first row of a key is always kept. The rows of all
    satellites lie side by side in this table of the shared folder.
    """
    w, _, _ = _in_slice()
    rows = states.withColumns({f"h_{n}": _hash([F.col(c) for c in cols]) for n, cols in SATELLITES.items()})
    before = {n: F.coalesce(F.lag(f"h_{n}").over(w), F.when(F.col("carried.eff").isNotNull(), _hash([F.col(f"carried.{c}") for c in cols]))) for n, cols in SATELLITES.items()}
    rows = rows.withColumns({f"b_{n}": c for n, c in before.items()})
    rows = rows.select("slice", *KEY, "eff", *(
        F.when(~F.col(f"h_{n}").eqNullSafe(F.col(f"b_{n}")), F.struct(F.col(f"h_{n}").alias("hash_diff"), *cols)).alias(n) for n, cols in SATELLITES.items()
    ))
    return stage(rows.where(F.coalesce(*(F.col(n)["hash_diff"] for n in SATELLITES)).isNotNull()), "satellites")


def views(changed: DataFrame) -> dict[str, DataFrame]:
    """name -> insert-only satellite (slice, key, eff, attributes, hash_diff) of changes()."""
    return {n: changed.where(F.col(n).isNotNull()).select("slice", *KEY, "eff", *(F.col(n)[c].alias(c) for c in cols), F.col(n)["hash_diff"].alias("hash_diff")) for n, cols in SATELLITES.items()}


def satellites(states: DataFrame) -> dict[str, DataFrame]:
    """name -> insert-only satellite of filled() states."""
    return views(changes(states))


def versions(changed: DataFrame) -> DataFrame:
    """The lead-based view over the satellites: key, object_text, status, valid_from_us, valid_to_us (-1: open)."""
    w, past, _ = _in_slice()
    forever = F.lit(2**63 - 1)
    dead = lambda fast: F.coalesce(F.lower(F.trim(fast["status"])).isin(*DEAD), F.lit(False))
    last = {f"p_{n}": F.max_by(n, F.when(F.col(n).isNotNull(), F.col("eff"))) for n in SATELLITES}
    rows = _neighbours(changed, last={**last, "p_eff": F.max("eff")}, first={"n_eff": F.min("eff")}, stored=True)
    rows = rows.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(past), f"p_{n}") for n in SATELLITES})
    rows = rows.withColumn("until", F.least(F.coalesce("ends.valid_to", forever), F.coalesce(F.lead("eff").over(w), "n_eff", forever)))
    rows = rows.withColumn("lives", ~dead(F.col("fast")) & (F.col("until") > F.col("eff"))).withColumn("look", F.concat("slow.hash_diff", "fast.hash_diff"))
    p_until = F.least(F.coalesce("p_ends.valid_to", forever), F.col("eff"))  # of the row before the slice
    p_lives = F.col("p_eff").isNotNull() & ~dead(F.col("p_fast")) & (p_until > F.col("p_eff"))
    carried = F.struct(p_lives.alias("lives"), p_until.alias("until"), F.concat("p_slow.hash_diff", "p_fast.hash_diff").alias("look"))
    before = F.coalesce(F.lag(F.struct("lives", "until", "look")).over(w), carried)
    rows = rows.withColumn("before", before)
    touches = F.coalesce(F.col("before.lives") & (F.col("before.until") == F.col("eff")) & (F.col("before.look") == F.col("look")), F.lit(False))
    alive = rows.where("lives").select("slice", *KEY, "eff", "until", F.col("slow.object_text").alias("object_text"), F.col("fast.status").alias("status"), F.when(~touches, F.col("eff")).alias("starts"))
    parts = alive.withColumn("island", F.last("starts", ignorenulls=True).over(past)).groupBy("slice", *KEY, "island").agg(
        F.max("until").alias("until"), F.min_by("object_text", "eff").alias("object_text"), F.min_by("status", "eff").alias("status")
    )
    # a part without start goes on from an earlier slice; it belongs to the last version begun there
    parts = stage(parts, "versions")
    by_slice = Window.partitionBy(*KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    summary = parts.groupBy("slice", *KEY).agg(F.max("island").alias("begun"), F.max(F.when(F.col("island").isNull(), F.col("until"))).alias("goes_on"))
    tails = summary.withColumn("owner", F.last("begun", ignorenulls=True).over(by_slice)).where("goes_on is not null")
    longer = tails.groupBy(*(F.col(k).alias(f"k_{k}") for k in KEY), "owner").agg(F.max("goes_on").alias("goes_on"))
    heads = parts.where("island is not null")
    on = reduce(lambda x, y: x & y, [heads[k].eqNullSafe(longer[f"k_{k}"]) for k in KEY], heads["island"] == longer["owner"])
    end = F.greatest("until", F.coalesce("goes_on", "until"))
    return heads.join(longer, on, "left").select(
        *KEY, "object_text", "status", F.col("island").alias("valid_from_us"), F.when(end == forever, F.lit(-1)).otherwise(end).cast("long").alias("valid_to_us")
    )


def belief_versions(beliefs: DataFrame, slices: int | None = None) -> DataFrame:
    """The versions of every key of beliefs."""
    return versions(changes(filled(sliced(effective_states(beliefs), slices))))
