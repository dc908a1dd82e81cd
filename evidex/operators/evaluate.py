"""Segmentation quality: boundaries, F1, Pk, WindowDiff, fragmentation.

The metrics of two arrays are for parents of bounded size, as a window rate looks at
every boundary for every window. boundary_metrics() works on one row per boundary,
in blocks of positions, so a parent of any length takes work in proportion to its
boundaries and spreads over tasks. segmentation_scores() takes parents of up to WHOLE
positions in one pass, boundaries and metrics together, and only longer ones that way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidex.functions.text import safe_rate
from evidex.operators.relational import latest_by_max
from evidex.operators.segments import BLOCK, fixed_windows, following, message_groups, together
from evidex.session import stage

#: Positions up to which segmentation_scores() takes a parent in one pass of one task, some 80 MB of rows at most; the result is the same.
WHOLE = 64 * BLOCK


def boundaries(assigned: DataFrame) -> DataFrame:
    """conversation_id, boundaries (ascending): the first positions of all segments but the first."""
    firsts = assigned.groupBy("conversation_id", "segment").agg(F.min("sequence_index").alias("b"))
    inner = F.filter(F.collect_set(F.struct("segment", "b")), lambda x: x["segment"] > 0)
    return firsts.groupBy("conversation_id").agg(F.array_sort(F.transform(inner, lambda x: x["b"])).alias("boundaries"))


def precision_recall_f1(expected: Column, predicted: Column) -> Column:
    """Struct of precision, recall and f1 of two boundary arrays; all 1 where both are empty."""
    tp = F.size(F.array_intersect(expected, predicted))
    fp, fn = F.size(F.array_except(predicted, expected)), F.size(F.array_except(expected, predicted))
    p, r = safe_rate(tp, tp + fp), safe_rate(tp, tp + fn)
    none = (F.size(expected) == 0) & (F.size(predicted) == 0)
    pick = lambda x: F.when(none, 1.0).otherwise(x)
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(safe_rate(2 * p * r, p + r)).alias("f1"))


def tolerant_matches(expected: Column, predicted: Column, tolerance: int) -> Column:
    """Predicted boundaries, in order, matched each with the first free expected one within the tolerance."""
    zero = F.struct(expected.alias("free"), F.lit(0).alias("hits"))

    def step(acc: Column, p: Column) -> Column:
        near = F.filter(acc["free"], lambda e: F.abs(e - p) <= tolerance)
        hit = F.size(near) > 0
        first = F.element_at(near, 1)
        gone = F.array_position(acc["free"], first).cast("int")
        rest = F.filter(acc["free"], lambda e, i: i != gone - 1)
        return F.struct(F.when(hit, rest).otherwise(acc["free"]).alias("free"), (acc["hits"] + F.when(hit, 1).otherwise(0)).alias("hits"))

    return F.aggregate(predicted, zero, step, lambda acc: acc["hits"])


def window_size(expected: Column, n: Column) -> Column:
    """Half the mean expected segment length, rounded half to even, between 1 and n - 1. expected: how many boundaries."""
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n / (expected + 1) / 2, 0).cast("int")))


def _inside(b: Column, start: Column, end: Column) -> Column:
    return F.size(F.filter(b, lambda x: (x > start) & (x <= end)))


def pk(expected: Column, predicted: Column, n: Column) -> Column:
    """Share of windows in which the two disagree on whether both ends are in one segment."""
    return _window_rate(expected, predicted, n, lambda e, p: (e == 0) != (p == 0))


def windowdiff(expected: Column, predicted: Column, n: Column) -> Column:
    """Share of windows in which the two count different boundaries."""
    return _window_rate(expected, predicted, n, lambda e, p: e != p)


def _window_rate(expected: Column, predicted: Column, n: Column, differ) -> Column:
    k = window_size(F.size(expected), n)
    starts = F.when(n > k, F.sequence(F.lit(0), (n - k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    bad = F.size(F.filter(starts, lambda s: differ(_inside(expected, s, s + k), _inside(predicted, s, s + k))))
    return F.when(n < 2, 0.0).otherwise(safe_rate(bad, F.size(starts)))


def boundary_rows(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """conversation_id, at, e, p: the first positions of all segments but the first; 1 where expected or predicted, else 0."""

    def firsts(assigned: DataFrame, e: int, p: int) -> DataFrame:
        rows = assigned.groupBy("conversation_id", "segment").agg(F.min("sequence_index").cast("long").alias("at")).where("segment > 0")
        return rows.select("conversation_id", "at", F.lit(e).alias("e"), F.lit(p).alias("p"))

    return firsts(expected, 1, 0).unionByName(firsts(predicted, 0, 1)).groupBy("conversation_id", "at").agg(F.max("e").alias("e"), F.max("p").alias("p"))


def _matched(tolerance: int, block: int):
    """Rows (k, block, at, e, p) ordered so -> k, block, hits, left: what the block adds, and how many expected boundaries around its
    end are used up, for every number of them used up around its start."""

    def table(b: int, expected: list[int], predicted: list[int]) -> tuple[list[int], list[int]]:
        lo, hi = b * block, (b + 1) * block
        near, last = sum(x < lo + tolerance for x in expected[: 2 * tolerance]), sum(x < hi - tolerance for x in expected)
        hits, left = [], []
        for j in range(near + 1):
            n = 0
            for x in predicted:
                while j < len(expected) and expected[j] < x - tolerance:
                    j += 1
                if j < len(expected) and expected[j] <= x + tolerance:
                    j, n = j + 1, n + 1
            hits.append(n)
            left.append(max(0, j - last))
        return hits, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, expected, predicted = None, [], []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "at", "e", "p"))):
                if at != row[:2]:
                    if at:
                        out.append((*at, *table(at[1], expected, predicted)))
                    at, expected, predicted = row[:2], [], []
                if row[3]:
                    expected.append(row[2])
                if row[4]:
                    predicted.append(row[2])
            yield _batch(out, batch.schema.field("k").type)
        if at:
            yield _batch([(*at, *table(at[1], expected, predicted))], batch.schema.field("k").type)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    k, block, hits, left = zip(*rows) if rows else ((), (), (), ())
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(block, pa.int64()), pa.array(hits, lists), pa.array(left, lists)], names=["k", "block", "hits", "left"])


def _near(bounds: DataFrame, tolerance: int, block: int) -> DataFrame:
    """conversation_id, near: tolerant_matches() of boundary_rows().

    Blocks share the expected boundaries around a border; what a block does depends on how many of these are used up.
    """
    of = lambda x: F.floor(x / block)
    spread = F.when(F.col("e") == 1, F.sequence(of(F.col("at") - tolerance), of(F.col("at") + tolerance))).otherwise(F.array(of(F.col("at"))))
    rows = bounds.select(F.col("conversation_id").alias("k"), F.explode(spread).alias("block"), "at", "e", "p")
    rows = rows.withColumn("p", F.when(of(F.col("at")) == F.col("block"), F.col("p")).otherwise(0))
    kind = rows.schema["k"].dataType.simpleString()
    tables = together(rows, ["k", "block"]).sortWithinPartitions("k", "block", "at").mapInArrow(_matched(tolerance, block), f"k {kind}, block long, hits array<long>, left array<long>")
    zero = F.struct(F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("near"))

    def step(acc: Column, b: Column) -> Column:
        used = F.when(acc["block"] + 1 == b["block"], acc["used"]).otherwise(F.lit(0)).cast("int")
        return F.struct(b["block"].alias("block"), F.get(b["left"], used).alias("used"), (acc["near"] + F.get(b["hits"], used)).alias("near"))

    chain = F.array_sort(F.collect_list(F.struct("block", "hits", "left")))  # one small entry per block
    return tables.groupBy("k").agg(F.aggregate(chain, zero, step, lambda acc: acc["near"]).alias("near")).withColumnRenamed("k", "conversation_id")


def _window_counts(bounds: DataFrame, sized: DataFrame, block: int) -> DataFrame:
    """conversation_id, split, differ: windows in which pk() and windowdiff() see a disagreement. sized: conversation_id, k, windows.

    Counts in a window only change where a boundary comes into it or leaves it, so what counts is the distance between changes.
    """
    first = lambda x: F.greatest(F.lit(0).cast("long"), x)
    change = lambda at, sign: F.struct(first(at).alias("at"), (sign * F.col("e")).cast("long").alias("e"), (sign * F.col("p")).cast("long").alias("p"))
    x = bounds.join(sized, "conversation_id").select("conversation_id", "windows", F.explode(F.array(change(F.col("at") - F.col("k"), 1), change(F.col("at"), -1))).alias("x"))
    x = x.groupBy("conversation_id", "windows", F.col("x.at").alias("at")).agg(F.sum("x.e").alias("e"), F.sum("x.p").alias("p")).withColumn("block", F.floor(F.col("at") / block))
    blocks = x.groupBy("conversation_id", "block").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.min("at").alias("at"))
    of_all = Window.partitionBy("conversation_id").orderBy("block")  # one row per block
    before = lambda c: F.coalesce(F.sum(c).over(of_all.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before")
    blocks = blocks.select("conversation_id", "block", before("e"), before("p"), F.lead("at").over(of_all).alias("next_block"))
    w = Window.partitionBy("conversation_id", "block").orderBy("at")
    now = lambda c: F.col(f"{c}_before") + F.sum(c).over(w)
    runs = x.join(blocks, ["conversation_id", "block"]).select("conversation_id", now("e").alias("e"), now("p").alias("p"), (F.least(F.coalesce(F.lead("at").over(w), "next_block", "windows"), "windows") - F.col("at")).alias("n"))
    count = lambda c: F.sum(F.when(c & (F.col("n") > 0), F.col("n")).otherwise(0))
    return runs.groupBy("conversation_id").agg(count((F.col("e") == 0) != (F.col("p") == 0)).alias("split"), count(F.col("e") != F.col("p")).alias("differ"))


def boundary_metrics(bounds: DataFrame, lengths: DataFrame, tolerance: int = 1, block: int = BLOCK) -> DataFrame:
    """conversation_id, precision, recall, f1, within, pk, windowdiff of boundary_rows(), as the functions of two arrays give them.

    lengths: conversation_id, n of every parent, also of those without boundaries.
    """
    bounds = stage(bounds, "bounds")
    counts = bounds.groupBy("conversation_id").agg(F.sum("e").alias("ne"), F.sum("p").alias("np"), F.sum(F.col("e") * F.col("p")).alias("tp"))
    sized = lengths.join(counts, "conversation_id", "left").fillna(0, ["ne", "np", "tp"]).withColumn("k", window_size(F.col("ne"), F.col("n")))
    sized = stage(sized.withColumn("windows", F.greatest(F.lit(0), F.col("n") - F.col("k")).cast("long")), "sized")
    found = sized.join(_near(bounds, tolerance, block), "conversation_id", "left").join(_window_counts(bounds, sized.select("conversation_id", "k", "windows"), block), "conversation_id", "left")
    return _rates(found.fillna(0, ["near", "split", "differ"]))


def _rates(found: DataFrame) -> DataFrame:
    """The metrics of rows conversation_id, n, windows, ne, np, tp, near, split, differ."""
    p, r = safe_rate(F.col("tp"), F.col("np")), safe_rate(F.col("tp"), F.col("ne"))
    pick = lambda x: F.when((F.col("ne") == 0) & (F.col("np") == 0), 1.0).otherwise(x)
    rate = lambda c: F.when(F.col("n") < 2, 0.0).otherwise(safe_rate(F.col(c), F.col("windows")))
    return found.select(
        "conversation_id", pick(p).alias("precision"), pick(r).alias("recall"), pick(safe_rate(2 * p * r, p + r)).alias("f1"), F.col("near").cast("int").alias("within"), rate("split").alias("pk"), rate("differ").alias("windowdiff")
    )


def _starts(items: list[tuple[int, int]], target: int) -> list[int]:
    """First positions of all segments but the first, of (position, size) in order."""
    out, open_ = [], target + 1
    for at, size in items:
        if open_ + size > target:
            out.append(at)
            open_ = size
        else:
            open_ += size
    return out[1:]


def _counts(rows: list[tuple[int, str, int]], target: int, tolerance: int) -> tuple[int, ...]:
    """n, windows, ne, np, tp, near, split, differ of one parent's (position, role, size) in order, the last row of a position counting."""
    rows = [r for r, following in zip(rows, [*rows[1:], (None,)]) if r[0] != following[0]]
    units, before = [], ""
    for at, role, size in rows:
        if role == "assistant" and before == "user":
            units[-1] = (units[-1][0], units[-1][1] + size)
        else:
            units.append((at, size))
        before = role
    expected, predicted = _starts(units, target), _starts([(at, size) for at, _, size in rows], target)
    n, ne, j, near = rows[-1][0] + 1, len(expected), 0, 0
    for x in predicted:
        while j < ne and expected[j] < x - tolerance:
            j += 1
        if j < ne and expected[j] <= x + tolerance:
            j, near = j + 1, near + 1
    k = max(1, min(n - 1, round(n / (ne + 1) / 2)))
    windows, split, differ = max(0, n - k), 0, 0
    changes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for which, bounds in enumerate((expected, predicted)):
        for b in bounds:
            changes[max(0, b - k)][which] += 1
            changes[b][which] -= 1
    at = e = p = 0
    for upto in [*sorted(changes), windows]:
        length = min(upto, windows) - at
        if length > 0:
            split, differ, at = split + length * ((e == 0) != (p == 0)), differ + length * (e != p), at + length
        if upto in changes:
            e, p = e + changes[upto][0], p + changes[upto][1]
    return n, windows, ne, len(predicted), len(set(expected) & set(predicted)), near, split, differ


def _counted(target: int, tolerance: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conversation_id, sequence_index, role, tokens) ordered so -> _counts() of every conversation."""
    names = ["conversation_id", "n", "windows", "ne", "np", "tp", "near", "split", "differ"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind if not i else pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), []
        for k, of in groupby(rows, itemgetter(0)):
            out.append((k, *_counts([r[1:] for r in of], target, tolerance)))
            if len(out) == 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    return run


def segmentation_scores(deliveries: DataFrame, target: int = 200, tolerance: int = 1, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """boundary_metrics() of message_groups() (expected) and fixed_windows() (predicted).

    deliveries: id, conversation_id, sequence_index, imported_at, role, tokens; of several rows of one number the last counts.
    """
    of = deliveries.groupBy("conversation_id").agg(F.min("sequence_index").alias("lo"), F.max("sequence_index").alias("hi"), F.count(F.lit(1)).alias("rows"))
    long = stage(of.where((F.col("lo") < 0) | (F.col("hi") >= whole) | (F.col("rows") > 2 * whole)).select("conversation_id"), "long")
    rows = deliveries.join(long, "conversation_id", "left_anti").withColumn("role", F.lower(F.coalesce("role", F.lit(""))))
    rows = together(rows, ["conversation_id"]).sortWithinPartitions("conversation_id", "sequence_index", "imported_at", "id").select("conversation_id", "sequence_index", "role", "tokens")
    kind = rows.schema["conversation_id"].dataType
    counts = rows.mapInArrow(_counted(target, tolerance, to_arrow_type(kind)), f"conversation_id {kind.simpleString()}, n int, windows long, ne long, np long, tp long, near long, split long, differ long")
    if long.isEmpty():
        return _rates(counts)
    m = stage(latest_by_max(deliveries.join(long, "conversation_id", "left_semi"), ["conversation_id", "sequence_index"], ["imported_at", "id"]), "sized")
    lengths = m.groupBy("conversation_id").agg((F.max("sequence_index") + 1).cast("int").alias("n"))
    return _rates(counts).unionByName(boundary_metrics(boundary_rows(message_groups(m, target), fixed_windows(m, target)), lengths, tolerance, block))


def near_duplicate(a: Column, b: Column, least: float = 0.9) -> Column:
    """Equal normalised texts, or token sets with a Jaccard similarity of at least 0.9."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    union = F.size(F.array_union(ta, tb))
    return (a == b) | ((a != "") & (b != "") & (F.size(F.array_intersect(ta, tb)) / union >= least))


def fragmentation(segments: DataFrame, floors: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Rates of small segments, of pairs of tiny neighbours and of near-duplicate neighbours. segments: conversation_id, segment, tokens, text.

    The neighbour is the next segment there is, whatever the gap in the numbers; it is found in blocks of them.
    """
    rows = following(segments, "conversation_id", "segment", ["tokens", "text"])
    pair = F.col("next_tokens").isNotNull()
    rate = lambda c, n: F.round(safe_rate(F.sum(F.when(c, 1).otherwise(0)), n), 6)
    pairs = F.count("next_tokens")
    return rows.agg(
        F.count(F.lit(1)).alias("segments"), *(rate(F.col("tokens") < f, F.count(F.lit(1))).alias(f"sub_{f}_rate") for f in floors), pairs.alias("pairs"),
        rate(pair & (F.col("tokens") < 100) & (F.col("next_tokens") < 100), pairs).alias("tiny_pair_rate"), rate(pair & near_duplicate(F.col("text"), F.col("next_text")), pairs).alias("duplicate_pair_rate"),
    )


def split_rates(scored: DataFrame) -> DataFrame:
    """over and under segmentation of rows with the arrays expected and predicted."""
    e, p = F.size("expected"), F.size("predicted")
    rate = lambda c: F.round(safe_rate(F.sum(F.when(c, 1).otherwise(0)), F.count(F.lit(1))), 6)
    return scored.agg(
        rate(p > e).alias("over_split_rate"), rate(p < e).alias("under_split_rate"), F.round(safe_rate(F.sum(p + 1), F.sum(e + 1)), 6).alias("segment_ratio"),
        F.round(safe_rate(F.sum(F.when((e == 0) & (p > 0), 1).otherwise(0)), F.sum(F.when(e == 0, 1).otherwise(0))), 6).alias("false_split_rate"),
    )


def percentiles(df: DataFrame, value: str, keys: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, rounded half to even to whole numbers, one column per point."""
    return df.groupBy(*keys).agg(*(F.bround(F.percentile(value, p), 0).cast("long").alias(n) for n, p in points.items()))


def macro_scores(scored: DataFrame) -> DataFrame:
    """One row: parents and the mean of every per-parent metric (precision, recall, f1, pk, windowdiff)."""
    return scored.agg(F.count(F.lit(1)).alias("parents"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "pk", "windowdiff")))
