import random

from conftest import ts

from evidex.llm import conversations as C

SCHEMA = "id string, conversation_id string, sequence_index int, role string, content_text string, imported_at timestamp_ntz, defect string, lo string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def headers(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def brute(rows, heads):
    by = {h: [] for h in heads if h}
    for r in rows:
        if r[1] is not None:
            by.setdefault(r[1], []).append(r)
    out = {}
    for c, ms in by.items():
        seen = [m[4] is not None and m[4].strip("​ \n\xa0") != "" for m in ms]
        who = [C.SPEAKERS.get((m[3] or "").strip().lower()) for m in ms]
        q = [m[2] for m in ms]
        if not any(seen):
            out[c] = "empty"
        elif c not in heads or None in who or None in q or len(set(q)) < len(q) or max(q) - min(q) + 1 != len(q):
            out[c] = "broken"
        else:
            runs = []
            for _, w, v in sorted(zip(q, who, seen)):
                if w in ("user", "assistant"):
                    if runs and runs[-1][0] == w:
                        runs[-1][1] |= v
                    else:
                        runs.append([w, v])
            if any(w == "user" and (i + 1 == len(runs) or not runs[i + 1][1]) for i, (w, _) in enumerate(runs)):
                out[c] = "unanswered"
    return out


def test_verdicts_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in range(120):
        for s in range(rng.randrange(0, 9)):
            if rng.random() < 0.03:
                continue
            rows.append((f"{c}-{s}", f"c{c}", s if rng.random() > 0.02 else None, rng.choice(["user", "Human ", "assistant", "MODEL", "tool", "system"] * 6 + ["??", None]), rng.choice(["hi", "yo", None, "", "​", " \xa0\n"]), ts(f"2024-0{rng.randrange(1, 9)}-01T00:00:00")))
    for s in range(3000):  # one long conversation over several blocks
        rows.append((f"h{s}", "hot", s, "user" if s % 2 == 0 else "assistant", "x" if s != 2047 else "", ts("2024-03-01T00:00:00")))
    rows.append(("n", None, 0, "user", "x", ts("2024-01-01T00:00:00")))
    heads = {f"c{c}" for c in range(0, 130) if c % 11} | {"hot"}
    m = messages(spark, rows)
    v = C.verdicts(m, headers(spark, [*heads, None]))
    got = {r["conversation_id"]: r["defect"] for r in v.where("defect is not null").collect()}
    want = brute(rows, heads)
    assert want["hot"] == "unanswered" and got == want
    whole = [r[1:4] for r in C.dialogues(m, v).select("content_text", "conversation_id", "turn", "speaker").collect()]
    counts = {}
    for c, t, _ in whole:
        counts.setdefault(c, []).append(t)
    assert all(sorted(t) == list(range(len(t))) for t in counts.values()) and not set(counts) & set(want)


def test_small_triggers_lose_nothing(spark):
    rows = [(f"{c}-{s}", f"c{c}", s, "user" if s % 2 == 0 else "assistant", "x", ts(f"2024-0{1 + s}-01T00:00:00")) for c in range(5) for s in range(4)]
    feed = C.feed_of(messages(spark, rows)).repartition(6)
    blocks = C.run_feed(feed, "400 days", files_per_trigger=1)
    assert sorted((r["conversation_id"], r["messages"]) for r in blocks.collect()) == [(f"c{c}", 4) for c in range(5)]


def test_empty(spark):
    assert C.verdicts(messages(spark, []), headers(spark, [])).count() == 0
    got = C.verdicts(messages(spark, []), headers(spark, ["a"])).collect()
    assert [(r["conversation_id"], r["defect"]) for r in got] == [("a", "empty")]


def _days(*days):
    return [ts(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}T00:00:00") for d in days]


def test_a_row_later_than_the_timeout_corrects_the_verdict(spark):
    """c is judged unanswered when it closes and whole once its late reply is there; d is whole until a number comes twice."""
    q1, q2, r2, late, twice = _days(0, 0, 1, 200, 200)
    rows = [("a", "c", 0, "user", "hi", q1), ("b", "d", 0, "user", "hi", q2), ("e", "d", 1, "assistant", "yo", r2), ("f", "x", 0, "user", "hi", _days(100)[0]), ("g", "c", 1, "assistant", "yo", late), ("h", "d", 1, "assistant", "again", twice)]
    m, h = messages(spark, rows), headers(spark, ["c", "d", "x"])
    feed = C.stage(C.feed_of(m), "late")
    closed = C.play_feed(feed, timeout="30 days", spans=3)
    first = {r["conversation_id"]: r["answered"] for r in C.fold_blocks(closed).collect()}
    assert first == {"c": False, "d": True, "x": False}
    got = {r["conversation_id"]: r["defect"] for r in C.verdicts(m, h, timeout="30 days").collect()}
    assert got == {"c": None, "d": "broken", "x": "unanswered"} == {"c": None, **brute(rows, {"c", "d", "x"})}


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    import pytest

    part = lambda *rows: C.feed_of(messages(spark, list(rows))).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(C.feed_of(messages(spark, [])).schema).parquet(f"{tmp_path}/in")
    part(("a", "c", 0, "user", "hi", _days(200)[0]))
    C.play(stream(), str(tmp_path), "5 days")
    part(("b", "d", 0, "user", "hi", _days(10)[0]))
    with pytest.raises(ValueError, match="behind the watermark"):
        C.play(stream(), str(tmp_path), "5 days")


def test_first_deliveries_only(spark):
    rows = [("a", "s", "X1", "c", 0, "user", "hi", _days(0)[0]), ("b", "s", " x1 ", "c", 0, "user", "hi", _days(5)[0]), ("d", "s", None, "c", 1, "assistant", "yo", _days(1)[0]), ("e", "s", None, "c", 2, "user", "so", _days(1)[0])]
    m = spark.createDataFrame(rows, "id string, source_id string, external_id string, conversation_id string, sequence_index int, role string, content_text string, imported_at timestamp_ntz")
    assert sorted(r["id"] for r in C.feed_of(m, deduplicate=True).collect()) == ["a", "d", "e"]
