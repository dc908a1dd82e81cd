import random
import time

from pyspark.sql import functions as F

from evidex.operators import evaluate as E
from evidex.operators import segments as SG
from evidex.plans import catalog, serving

COLS = ["precision", "recall", "f1", "within", "pk", "windowdiff"]


def test_rows_give_what_arrays_give(spark):
    rng = random.Random(5)
    cases = [("none", [], [], 6), ("one", [], [], 1), ("chain", list(range(1, 40)), list(range(2, 41)), 41), ("far", [900], [2, 901], 1000), ("only e", [3], [], 5), ("only p", [], [3], 5)]
    for i in range(150):
        n = rng.choice([2, 3, 9, 40, 120])
        draw = lambda n=n, share=rng.random(): [x for x in range(1, n) if rng.random() < share]
        cases.append((f"c{i}", draw(), draw(), n))
    df = spark.createDataFrame(cases, "conversation_id string, e array<int>, p array<int>, n int")
    e, p, n = F.col("e"), F.col("p"), F.col("n")
    f = E.precision_recall_f1(e, p)
    for tolerance in (1, 3):
        want = df.select("conversation_id", f["precision"], f["recall"], f["f1"], E.tolerant_matches(e, p, tolerance), E.pk(e, p, n), E.windowdiff(e, p, n)).collect()
        of = lambda c: df.select("conversation_id", F.posexplode(F.concat(F.array(F.lit(0)), c)).alias("segment", "sequence_index"))
        got = E.boundary_metrics(E.boundary_rows(of(e), of(p)), df.select("conversation_id", "n"), tolerance, block=4).select("conversation_id", *COLS).collect()
        assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_long_conversation(spark, tmp_path):
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("c").alias("conversation_id"), F.col("id").cast("int").alias("sequence_index"), F.lit("user").alias("role"),
        F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 300).otherwise(150)).alias("content_text"), F.timestamp_seconds(F.lit(0)).alias("imported_at"),
    )
    rows.write.parquet(str(tmp_path / "messages.parquet"))
    began = time.time()
    (r,) = catalog.boundary_scores(spark, str(tmp_path)).collect()
    assert time.time() - began < 120
    assert tuple(r) == ("c", 1.0, 1.0, 1.0, n // 2 - 1, 0.0, 0.0)


def test_macro_of_long_conversation(spark, tmp_path):
    n = 20_001
    rows = spark.range(n + 1).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") < n, "c").otherwise("short").alias("conversation_id"), (F.col("id") % n).cast("int").alias("sequence_index"), F.lit("user").alias("role"),
        F.repeat(F.lit("x"), 600).alias("content_text"), F.timestamp_seconds(F.lit(0)).alias("imported_at"),
    )
    rows.write.parquet(str(tmp_path / "messages.parquet"))
    began = time.time()
    (r,) = serving.macro_boundary_scores(spark, str(tmp_path)).collect()
    assert time.time() - began < 120
    assert r.asDict() == {"parents": 2, "precision": 1.0, "recall": 1.0, "f1": 1.0, "pk": 0.0, "windowdiff": 0.0}


def _deliveries(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for at in [x for x in range(rng.choice([2, 9, 40, 300])) if rng.random() < 0.8] or [0]:
            for again in range(rng.choice([1, 1, 1, 3])):
                rows.append((f"{c}-{at}-{again}", f"c{c}", at, rng.choice([None, 1, 2, 3]), rng.choice(["user", "User", "assistant", "ASSISTANT", "tool", None]), rng.choice([0, 1, 60, 130, 250])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id string, conversation_id string, sequence_index int, imported_at int, role string, tokens int")


def test_one_pass_gives_what_blocks_give(spark):
    d = _deliveries(spark)
    took = {b: {r[0]: tuple(r) for r in E.segmentation_scores(d, block=b, whole=b).select("conversation_id", *COLS).collect()} for b in (4, 64, 4096)}
    assert len(took[4096]) == 60 and took[4] == took[64] == took[4096]
    odd = d.withColumn("sequence_index", F.col("sequence_index") - 1)  # a number below 0 leaves the one pass too
    assert E.segmentation_scores(odd).count() == 60


def test_short_conversations_take_few_jobs(spark, tmp_path):
    _deliveries(spark).select("*", F.repeat(F.lit("x"), F.col("tokens")).alias("content_text")).write.parquet(str(tmp_path / "messages.parquet"))
    spark.sparkContext.setJobGroup("short", "macro_boundary_scores")
    (r,) = serving.macro_boundary_scores(spark, str(tmp_path)).collect()
    assert r["parents"] == 60 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("short")) <= 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_greedy_over_many_files(spark):
    """Items in many files, too large to be broadcast by plan; what they are joined with turns out small at run time."""
    rows = [(f"k{k}", p, 1 + (7 * k + 3 * p) % 9) for k in range(200) for p in range(12)] + [(f"long{k}", p, 3) for k in range(20) for p in range(40)]
    random.Random(3).shuffle(rows)
    items = spark.createDataFrame(rows, "k string, pos int, size int").repartition(8)
    want = {}
    for k in {r[0] for r in rows}:
        segment, open_ = -1, 21
        for _, p, size in sorted(r for r in rows if r[0] == k):
            segment, open_ = (segment + 1, size) if open_ + size > 20 else (segment, open_ + size)
            want[k, p] = segment
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert {(r["k"], r["pos"]): r["segment"] for r in SG.greedy(items, "k", "pos", "size", 20, block=16).collect()} == want
    finally:
        for k in conf:
            spark.conf.unset(k)
