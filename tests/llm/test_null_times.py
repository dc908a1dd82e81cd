from conftest import ts

from evidex.llm import conversations as C


def test_a_message_without_a_time_is_there(spark):
    rows = [("a", "c", 0, "user", "hi", None), ("b", "c", 1, "assistant", "yo", ts("2024-03-01T00:00:00")), ("d", "e", 0, "user", "hi", ts("2024-01-01T00:00:00")), ("f", "e", 1, "assistant", "yo", None), ("g", "n", 0, "assistant", "yo", None)]
    m = spark.createDataFrame(rows, "id string, conversation_id string, sequence_index int, role string, content_text string, imported_at timestamp_ntz")
    v = C.verdicts(m, spark.createDataFrame([("c",), ("e",), ("n",)], "id string"))
    assert {r["conversation_id"]: r["defect"] for r in v.collect()} == {"c": None, "e": None, "n": None}
