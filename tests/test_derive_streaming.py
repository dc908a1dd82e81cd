from conftest import ts
from pyspark.sql import functions as F

from evidex.operators import derive as D
from evidex.streaming import feeds


def test_embed_pending_once(spark):
    seg = spark.createDataFrame([("a b c",), ("a b c",), ("other",), (None,), ("  ",)], "content_text string")
    none = spark.createDataFrame([], "input_sha256 string, embedding_model_version string")
    first = D.embed_pending(seg, none, "v1")
    rows = first.collect()
    assert len(rows) == 2 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 and r["embedding_dimension"] == 64 for r in rows)
    assert D.embed_pending(seg, first, "v1").count() == 0 and D.embed_pending(seg, first, "v2").count() == 2


def test_generations_and_invalidation(spark):
    g = spark.createDataFrame([("c", "g1", 1), ("c", "g2", 2), ("d", "g3", 1)], "conversation_id string, generation_id string, created_at int")
    s = spark.createDataFrame([("g1", "s1"), ("g2", "s2"), ("g2", "s3")], "generation_id string, segment_id string")
    e = spark.createDataFrame([("s1",), ("s2",)], "segment_id string")
    assert {tuple(r) for r in D.active_generations(g, s, e).collect()} == {("c", "g1"), ("d", "g3")}
    seg = spark.createDataFrame([("a", "c1", ["m1", "m2"]), ("b", "c1", ["m3"]), ("x", "c2", None)], "id string, conversation_id string, message_ids array<string>")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert {r[0] for r in D.invalidated(seg, ids("m2")).collect()} == {"a"}
    assert {r[0] for r in D.invalidated(seg, ids("m2"), ids("c2")).collect()} == {"a", "x"}
    assert D.invalidated(seg).count() == 0


def test_payloads_and_parts(spark):
    ok = '{"segments":[{"title":"t","summary":null,"message_ids":["1"],"content_text":"x"}]}'
    bad = ['{"segments":[]}', '{"segments":[{"title":"t","content_text":"x"}]}', '{"segments":[{"title":"t","summary":"s","message_ids":[],"content_text":" "}]}', "no", None, ok[:-1] + ',"more":1}']
    df = spark.createDataFrame([(p,) for p in [ok, *bad]], "p string")
    got = [r[0] for r in df.select(D.parsed_segments(F.col("p"))).collect()]
    assert got[0][0]["message_ids"] == ["1"] and got[1:] == [None] * len(bad)
    parts = D.chain_of_parts(spark.createDataFrame([("a", "x" * 10), ("b", "")], "id string, text string"), 4).collect()
    assert [r["text"] for r in parts if r["id"] == "a"] == ["xxx", "xxx", "xxx", "x"] and [r["text"] for r in parts if r["id"] == "b"] == [""]


def test_small_helpers(spark):
    runs = spark.createDataFrame([("r1", "k", 1.0), ("r2", "k", 2.0), ("r3", "k", 2.0), ("r4", "j", None)], "run_id string, kind string, f1 double")
    assert [r["run_id"] for r in D.best_run(runs, "f1", ["kind"]).collect()] == ["r2"]
    b = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1"), ("c", "2")], "k string, bundle_id string")
    got = {r["k"]: r["bundle"] for r in D.bundle_ids(b, ["k"]).collect()}
    assert got["a"] == "1" and got["b"] == "unknown" and len(got["c"]) == 64
    p = spark.createDataFrame([("1", "t"), ("2", None)], "id string, tenant_id string")
    r = spark.createDataFrame([("1", "t"), ("2", "x"), ("3", "t"), ("2", None)], "id string, tenant_id string")
    assert sorted(tuple(x) for x in D.reference_defects(r, p, "id", ["tenant_id"]).collect()) == [("2", "other boundary"), ("3", "unknown parent")]


def test_streams(spark, tmp_path):
    schema = "id string, source_id string, external_id string, imported_at timestamp_ntz, raw string, zone string, locale string"
    t = ts("2024-01-01T00:00:00")
    batches = [[("1", "s", "p:1", t, "1714557600", None, None), ("2", "s", "P:1", t, "x", None, None)], [("3", "s", "p:1 ", t, "1714557600", None, None), ("4", "s", "p:2", t, "x", "UTC", None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for start, home in ((feeds.dedupe, "d"), (feeds.normalise, "n"), (lambda s, h: feeds.latest_state(s, h, ["source_id"], ["id"]), "l")):
            start(stream, str(tmp_path / home)).awaitTermination()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "d/kept")).collect()} == {"1", "4"}
    assert spark.read.parquet(str(tmp_path / "n/dictionary/part-0")).count() == 2 and spark.read.parquet(str(tmp_path / "n/dictionary/part-1")).count() == 1
    assert spark.read.parquet(str(tmp_path / "n/rows")).count() == 4
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "l/state/1")).collect()] == ["4"]


def test_event_windows(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    rows = [(ts("2024-01-01T00:01:00"), "a", 1.0), (ts("2024-01-01T00:02:00"), "a", 2.0), (ts("2024-01-01T05:00:00"), "b", 1.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for n, make in enumerate((lambda s: feeds.tumbling(s, "ts", ["k"], "v", "10 minutes", "1 minute"), lambda s: feeds.sessions(s, "ts", ["k"], "10 minutes", "1 minute"))):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start(str(tmp_path / f"o{n}"))
        q.awaitTermination()
        assert [(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / f"o{n}")).collect()] == [("a", 2)]


def test_keyed_state_over_a_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "COMPACT", 2)
    schema = "k string, n int"
    for n, rows in enumerate([[("a", 1), ("b", 5)], [("a", 3)], [("c", 1), ("a", 2)], [("b", 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.latest_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "l"), ["k"], ["n"]).awaitTermination()
        want = {0: {"a": 1, "b": 5}, 1: {"a": 3, "b": 5}, 2: {"a": 3, "b": 5, "c": 1}, 3: {"a": 3, "b": 6, "c": 1}}[n]
        assert {r["k"]: r["n"] for r in feeds.current_state(spark, str(tmp_path / "l"), ["k"], ["n"], schema, n).collect()} == want
    assert {r["k"] for r in spark.read.parquet(str(tmp_path / "l/state/3")).collect()} == {"b"}
