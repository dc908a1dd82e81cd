import json

import pytest
from pyspark.sql import functions as F

from evidex.functions.text import opaque_id
from evidex.operators import review as V


def test_fetch_needs_an_allowed_corpus(spark):
    c = spark.createDataFrame([("1", "t", "c", 0), ("2", "t", "d", 0)], "item_id string, tenant_id string, corpus_id string, privacy_tier int")
    ref = c.select(opaque_id(F.struct("corpus_id", "item_id", "tenant_id"))).first()[0]
    assert "=" not in ref
    assert [r["item_id"] for r in V.fetch(c, ref, [("t", "c")]).collect()] == ["1"]
    assert V.fetch(c, ref, [("t", "d")]).count() == 0
    with pytest.raises(ValueError):
        V.fetch(c, "no!", [("t", "c")])


def test_audits_and_fixtures(spark):
    a = spark.createDataFrame([("1", '{"x":1}', ["budget"]), ("2", '{"a":{"Content":1}}', None), ("3", None, ["odd"])], "id string, payload string, omitted array<string>")
    assert {tuple(r) for r in V.audit_defects(a, ["budget"]).collect()} == {("2", "content key"), ("3", "unknown reason")}
    rows = [{"kind": "header", "schema_version": "1"}, {"kind": "message", "id": "m"}, {"kind": "message", "id": "m"}, {"kind": "segment", "id": "s", "message_ids": ["m", "z"]}, {"id": "x"}, {"kind": "segment"}]
    lines = spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(rows)], "line int, value string")
    assert {tuple(r) for r in V.fixture_errors(lines, "1").collect()} == {(2, "repeated id m"), (3, "unknown message z"), (4, "no kind"), (5, "no id")}
    assert {r["error"] for r in V.fixture_errors(lines.where("line = 0"), "2").collect()} == {"schema version"}


def test_result_kind(spark):
    df = spark.createDataFrame([(1, 0), (0, 2), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(V.result_kind(F.col("a"), F.col("b"))).collect()] == ["populated", "accounted_zero", "clean_zero"]
