"""Edge cases of sampling, payload and packet operators."""

import json

from pyspark.sql import functions as F

from evidex.operators import claims as C
from evidex.operators import retrieval as S
from evidex.operators import sampling as P
from tests.conftest import ts

LABELS = "k string, at timestamp_ntz, verdict string, extra string"


def test_answers_cooldown_and_caps(spark):
    labels = spark.createDataFrame([("a", ts("2025-12-30T00:00:00"), "true", ""), ("a", ts("2025-12-31T00:00:00"), "skip", ""), (None, ts("2025-12-31T00:00:00"), None, ""), ("b", None, "true", "")], LABELS)
    last = P.last_answers(labels, ["k"], "at", "verdict", "skip")
    assert {r["k"]: r["last_at"] for r in last.collect()} == {"a": ts("2025-12-30T00:00:00"), None: ts("2025-12-31T00:00:00"), "b": None}
    pool = spark.createDataFrame([("a", "task", 1), ("a", "goal", 2), (None, "task", 3), ("b", "task", 4), ("c", None, 5)], "k string, kind string, n int")
    due = P.after_cooldown(pool, last, ["k"], "kind", {"task": 2, "goal": 14}, 0, ts("2026-01-01T00:00:00"))
    assert sorted(r["n"] for r in due.collect()) == [1, 4, 5]  # two days are enough for a task; null is a key of its own
    assert sorted(r["n"] for r in P.below_cap(pool, labels, ["k"], 2).collect()) == [3, 4, 5]
    assert P.below_cap(pool, labels, ["k"], 0).count() == 5 and P.after_cooldown(pool.limit(0), last, ["k"], "kind", {}, 1, ts("2026-01-01T00:00:00")).count() == 0
    assert [tuple(r) for r in P.progress(pool, labels, "kind", ["k"]).where("kind = 'task'").collect()] == [("task", 3, 3, 0)]
    assert [r["n"] for r in P.optional(pool, kind="goal", k=None).collect()] == [2]


def test_comparison_tags_and_states(spark):
    c = "segment_id string, predicate string, evidence_message_ids array<string>"
    prior = spark.createDataFrame([("s1", "p", ["a"]), ("s2", "p", ["a", "b"]), ("s3", "p", ["a"])], c)
    cand = spark.createDataFrame([("s2", "p", ["a"]), ("s3", "q", ["a"]), ("s4", "p", [])], c)
    got = {r["segment_id"]: (r["state"], r["tags"], r["state_rank"], r["risk_rank"]) for r in P.compare_segments(prior, cand).collect()}
    assert got["s1"] == ("candidate_zero", ["zeroed", "count_changed", "predicate_mix_changed"], 0, 0)
    assert got["s2"] == ("complete", ["provenance_anomaly"], 1, 2) and got["s3"] == ("complete", ["predicate_mix_changed"], 1, 4)
    assert got["s4"] == ("prior_missing", ["provenance_anomaly", "predicate_mix_changed"], 5, 2)
    assert P.compare_segments(prior.limit(0), cand.limit(0)).count() == 0
    assert [r["segment_id"] for r in P.queue(P.compare_segments(prior, cand), 2).collect()] == ["s1", "s2"]


def test_payloads(spark):
    claim = {"subject_text": "user", "predicate": "drives", "object_text": "a car", "object_json": None, "stability_class": "preference", "confidence": 0.5, "evidence_message_ids": ["m"], "rationale": ""}
    odd = {"scalar": 1, "no list": {"claims": 3}, "more": {"claims": [], "x": 1}, "none": {"claims": []}, "ok": {"claims": [claim]}}
    for k, v in (("subject_text", " "), ("predicate", "nope"), ("object_text", ""), ("object_json", [1]), ("stability_class", "x"), ("confidence", 1.5), ("confidence", "0.5"), ("evidence_message_ids", []), ("rationale", None)):
        odd[f"{k}={v}"] = {"claims": [claim, {**claim, k: v}]}
    odd["keys"] = {"claims": [{k: v for k, v in claim.items() if k != "rationale"}]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in odd.items()] + [("broken", "{"), ("null", None)], "key string, payload string")
    got = {r["key"]: r["defect"] for r in C.payload_defects(df).collect()}
    assert got["ok"] is None and got["none"] is None and got["scalar"] == got["more"] == got["broken"] == got["null"] == "must contain only claims" and got["no list"] == "claims must be a list"
    assert got["keys"] == "claim 0 does not match the schema" and got["subject_text= "] == "claim 1 has empty subject_text"
    assert all(v and v.startswith("claim 1 has") for k, v in got.items() if "=" in k)
    assert {r["key"]: r["defect"] for r in C.payload_defects(df, relaxed=True).collect()}["predicate=nope"] is None


def test_halves(spark):
    df = spark.createDataFrame([("a", ["1", "2", "3"], "x"), ("b", ["1"], "abc"), ("c", ["1"], "a"), ("d", [], "abc"), ("e", None, None)], "key string, items array<string>, text string")
    assert sorted((r["key"], r["half"], tuple(r["items"]), r["text"]) for r in C.halves(df).collect()) == [("a", 0, ("1",), None), ("a", 1, ("2", "3"), None), ("b", 0, ("1",), "a"), ("b", 1, ("1",), "bc")]


def test_packets_leave_out_duplicates_and_what_does_not_fit(spark):
    schema = "tenant_id string, corpus_id string, source_kind string, sub_kind string, external_id string, reference_id string, content string, score double, privacy_tier int, provenance string, dirty_working_tree boolean, freshness string"
    row = lambda ref, ext, content, score: ("t", "c", "k", "s", ext, ref, content, score, 1, "{}", False, "fresh")
    hits = spark.createDataFrame([row("r1", "a", "one two", 5.0), row("r1", "b", "again", 4.0), row("r2", "c", "w " * 500, 3.0), row("r3", "d d", "", 2.0)], schema)
    got = [(r["candidate_id"], r["reference_id"], r["cost"], r["selected"], r["reason"]) for r in S.build_packets(hits, 70).orderBy("rank").collect()]
    assert got == [("candidate-0001", "r1", 30, True, ""), ("candidate-0002", "r1", 29, False, "duplicate"), ("candidate-0003", "r2", 528, False, "over_budget"), ("candidate-0004", "r3", 30, True, "")]
    assert S.build_packets(hits.limit(0), 70).count() == 0 and not any(r["selected"] for r in S.build_packets(hits, 0).collect())


def test_updates_from_a_join(spark):
    rows = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "k string, status string")
    src = spark.createDataFrame([("a", 1), ("a", 1)], "id string, n int")
    assert sorted(map(str, P.update_from(rows, src, "k", "id", {"status": F.lit("new")}).collect())) == sorted(["Row(k='a', status='new')", "Row(k='b', status='old')", "Row(k=None, status='old')"])
