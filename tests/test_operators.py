import random

import pytest
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import claims as C
from evidex.operators import evaluate as E
from evidex.operators import graph as G
from evidex.operators import relational as R
from evidex.operators import retrieval as S
from evidex.operators import segments as SG


def brute_greedy(sizes, target):
    out, seg, size, full = [], -1, 0, True
    for s in sizes:
        if full or size + s > target:
            seg, size = seg + 1, 0
        size += s
        full = size > target
        out.append(seg)
    return out


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_greedy_equals_sequential_fold(spark, block):
    rng = random.Random(block)
    data = {k: [rng.choice([0, 1, 5, 9, 30]) for _ in range(n)] for k, n in (("hot", 120), ("b", 9), ("c", 1))}
    df = spark.createDataFrame([(k, i, s) for k, v in data.items() for i, s in enumerate(v)], "k string, pos int, size int")
    got = {}
    for r in SG.greedy(df, "k", "pos", "size", 20, block).collect():
        got.setdefault(r["k"], {})[r["pos"]] = r["segment"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: brute_greedy(v, 20) for k, v in data.items()}


def test_greedy_of_nothing(spark):
    assert SG.greedy(spark.createDataFrame([], "k string, pos int, size int"), "k", "pos", "size", 20).count() == 0


def test_previous_crosses_blocks(spark):
    df = spark.createDataFrame([("k", i, str(i)) for i in (0, 1, 2, 5, 9, 10)], "k string, pos int, v string")
    got = {r["pos"]: r["prev_v"] for r in SG.previous(df, "k", "pos", "v", block=3).collect()}
    assert got == {0: None, 1: "0", 2: "1", 5: "2", 9: "5", 10: "9"}


def test_boundary_metrics(spark):
    df = spark.createDataFrame([([3, 6], [3, 7], 10), ([], [], 5), ([], [2], 4), ([1], [], 1)], "e array<int>, p array<int>, n int")
    e, p, n = F.col("e"), F.col("p"), F.col("n")
    rows = df.select(E.precision_recall_f1(e, p)["f1"].alias("f1"), E.tolerant_matches(e, p, 1).alias("near"), E.pk(e, p, n).alias("pk"), E.windowdiff(e, p, n).alias("wd")).collect()
    assert [r["f1"] for r in rows] == [0.5, 1.0, 0.0, 0.0]
    assert [r["near"] for r in rows] == [2, 0, 0, 0]
    assert rows[0]["pk"] == rows[0]["wd"] == 0.25 and rows[3]["pk"] == 0.0


def test_snapshot_history(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "k string, h string")
    diff = R.snapshot_diff(old, new, "k", "h")
    assert {r["k"]: r["action"] for r in diff.collect()} == {"a": "noop", "b": "supersede", "c": "noop", "d": "insert"}
    hist = old.select("k", F.col("h").alias("hash"), F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    got = {(r["k"], r["hash"], r["valid_to"]) for r in R.apply_diff(hist, diff, "k", F.lit(9)).collect()}
    assert got == {("a", "1", None), ("b", "1", 9), ("b", "2", None), ("c", None, None), ("d", "1", None)}


def test_sinks_and_marks(spark):
    a = spark.createDataFrame([("x", "1"), (None, "1")], "k string, h string")
    b = spark.createDataFrame([("x", "2"), ("y", "1"), ("y", "1"), (None, "1")], "k string, h string")
    assert {r["k"] for r in R.conflicts(a, b, ["k"], "h").collect()} == {"x"}
    assert {r["k"] for r in R.insert_once(a, b, ["k"]).collect()} >= {"y"}
    assert R.pending(b, a, ["k"]).count() == 2 and R.answered(b, a, ["k"]).count() == 2
    p = spark.createDataFrame([("s", "failed", 1, 1), ("s", "done", 2, 5), ("t", "new", 0, 1)], "scope string, status string, error_count int, updated_at int")
    got = {r["scope"]: (r["status"], r["error_count"]) for r in R.upsert_progress(p.limit(1), p.subtract(p.limit(1)), ["scope"]).collect()}
    assert got["s"] == ("done", 3)
    none = a.limit(0)
    assert R.distribution_l1(none, none, "k").first()[0] == 0 and R.distribution_l1(a, none, "k").first()[0] is None
    with pytest.raises(PermissionError):
        R.secure_view(a, [])


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "source string, target string")
    got = {(r["node"], r["depth"]) for r in G.neighbourhood(links, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {("b", 1), ("c", 1), ("b", 2), ("c", 2)}
    with pytest.raises(ValueError):
        G.neighbourhood(links, links.select(F.col("source").alias("node")), 3)
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "n int, h int")
    heads = {r["n"]: r["head"] for r in G.chain_heads(chain, "n", "h", rounds=8).collect()}
    assert all(heads[i] == 50 for i in range(50)) and 100 not in heads
    tree = spark.createDataFrame([("c", "r", None, 0, False), ("c", "x", "r", 1, True), ("c", "y", "r", 0, True), ("c", "z", "y", 0, True), ("c", "p", "q", 5, True), ("c", "q", "p", 4, True)], "conversation_id string, node string, parent string, position int, has_message boolean")
    got = {r["node"]: r["sequence_index"] for r in G.preorder(tree).collect()}
    assert got == {"y": 0, "z": 1, "x": 2, "q": 3, "p": 4}


def test_text_functions(spark):
    df = spark.createDataFrame([(" Ｆoo  BAR!? ",), (None,), ("",)], "t string")
    t = F.col("t")
    rows = df.select(T.normalize_subject(t).alias("s"), T.normalize_value(t).alias("v"), T.token_estimate(t).alias("n"), T.slugify(t).alias("g"), T.excerpt(t, 3).alias("e")).collect()
    assert rows[0][:3] == ("foo bar", "foo bar!?", 5) and rows[2][:3] == ("", "", 0) and rows[1][0] is None and rows[2]["g"] == "section"
    ref = spark.createDataFrame([("path", "A\\B.md"), ("rfc_id", "see RFC-44"), ("decision_id", "d077 x"), ("commit_sha", "ABC")], "k string, v string")
    assert [r[0] for r in ref.select(T.reference_value(F.col("k"), F.col("v"))).collect()] == ["a/b.md", "rfc 0044", "D077", "abc"]
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><div> c  d</div>",), (None,)], "h string")
    assert [r[0] for r in html.select(T.html_to_text(F.col("h"))).collect()] == ["a & b\nc d", None]
    log = spark.createDataFrame([("token=abc123 ok",)], "l string")
    assert log.select(T.redact_secrets(F.col("l")), T.has_secret(F.col("l"))).first()[:] == ("[REDACTED] ok", True)
    js = spark.createDataFrame([('{"b":1,"a":{"content":2}}',), ("no",)], "j string")
    assert [tuple(r) for r in js.select(T.canonical_json(F.col("j")), T.has_content_key(F.col("j"))).collect()] == [('{"a":{"content":2},"b":1}', True), (None, False)]
    text = spark.createDataFrame([("a  \n[image: x]\n\n\n\nb\n",)], "t string")
    assert text.select(T.embeddable(F.col("t"))).first()[0] == "a\n\nb"


def test_packet_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([("1", 3.0, "a", "one two three"), ("2", 2.0, "b", " ".join(["w"] * 50)), ("3", 1.0, "c", "x")], "item_id string, score double, external_id string, content string")
    assert [(r["item_id"], r["included"]) for r in S.packet(hits, 10).orderBy("rank").collect()] == [("1", True), ("2", False), ("3", True)]


def test_consolidation_is_gaps_and_islands(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rng = random.Random(1)
    data = [(f"{n:04}", f"c{n}", "user", "drives", rng.choice(["car", "Car ", "bike"]), None, t0 + timedelta(hours=n), 0.5, 1) for n in range(120)]
    df = spark.createDataFrame(data, "id string, conversation_id string, subject_normalized string, predicate string, object_text string, object_json string, extracted_at timestamp_ntz, confidence double, privacy_tier int")
    runs = []
    for r in data:
        v = r[4].strip().lower()
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1, r[6]])
    got = [(r["value"], r["claims"], r["valid_from"]) for r in C.consolidate(df, slices=5).orderBy("valid_from").collect()]
    assert got == [("text:" + v, n, t) for v, n, t in runs]
    assert C.contradictions(C.consolidate(df, slices=3)).count() == len(runs) - 1
