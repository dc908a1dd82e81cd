"""The whole job where a query once did a part of it."""

from collections import defaultdict

import duckdb

from evidex.operators import claims as C
from evidex.operators import evaluate as E
from evidex.operators import retrieval as S
from evidex.operators.timestamps import parse_instant
from evidex.plans import catalog
from tests.conftest import ts


def corpus_rows(spark, sizes):
    """Rows of corpora (tenant, corpus, n, day), the newest of each first."""
    rows = [(f"{t}{c}{i:04d}", t, c, f"x{i:04d}", "doc", "belief history" if i == n - 1 else "nothing", ts(f"2025-01-{day:02d}T00:00:00"), None) for t, c, n, day in sizes for i in range(n)]
    schema = "item_id string, tenant_id string, corpus_id string, external_id string, sub_kind string, content string, recorded_at timestamp, provenance struct<path:string,commit_sha:string>"
    return spark.createDataFrame(rows, schema)


def test_newest_rows_are_those_of_one_corpus(spark):
    rows = corpus_rows(spark, [("t", "a", 5, 1), ("t", "b", 4, 20), ("u", "a", 6, 10)])
    found = S.search_each(rows, "belief history", 10, newest=5).collect()
    assert sorted((r["tenant_id"], r["corpus_id"], r["item_id"], r["rank"]) for r in found) == [("t", "a", "ta0004", 1), ("t", "b", "tb0003", 1)]


def test_packet_of_each_corpus(spark, tmp_path):
    corpus_rows(spark, [("t", "old", 3, 1), ("t", "new", 1100, 20)]).write.parquet(f"{tmp_path}/corpus_rows.parquet")
    got = catalog.queries()["packet"](spark, str(tmp_path)).collect()
    assert [(r["tenant_id"], r["corpus_id"], r["item_id"], r["rank"], r["included"]) for r in got] == [("t", "old", "told0002", 1, True)]


def test_beliefs_are_those_of_a_sequential_fold(spark, sf):
    con = duckdb.connect()
    rows = lambda q: con.execute(q).fetchall()
    t = lambda n: f"'{sf}/{n}.parquet'"
    zones = {b: (z, loc) for b, z, loc in rows(f"select batch_id, max(export_timezone), max(export_locale) from {t('ingest_results')} group by 1")}
    at = {i: (lambda us: us if us is not None else imp)(parse_instant(raw, *zones.get(batch, (None, None))) if raw else None) for i, raw, batch, imp in rows(f"select id, created_at, batch_id, epoch_us(imported_at) from {t('messages')}")}
    segments = {r[0] for r in rows(f"select id from {t('segments')} where is_active and source_kind in ('chatgpt', 'claude', 'gemini') and conversation_id is not null")}
    kept = [r for r in rows(f"select id, conversation_id, epoch_us(extracted_at), evidence_message_ids, segment_id from {t('claims')} where conversation_id is not null order by extracted_at, id") if r[4] in segments]
    assert len(kept) < con.execute(f"select count(*) from {t('claims')}").fetchone()[0]
    claims = spark.read.parquet(f"{sf}/claims.parquet")
    of = {r["id"]: tuple(r)[1:] for r in claims.join(C.vocabulary(spark), "predicate").select("id", "subject_normalized", "predicate", C.group_key().alias("k"), "v_cardinality").collect()}
    text = {r[0]: r[1] for r in C.value_groups(claims.withColumn("conversation_id", claims["id"])).select("first_id", "value").collect()}
    last, groups = defaultdict(int), defaultdict(list)
    for i, conversation, extracted, evidence, _ in kept:
        last[conversation] = max(last[conversation], extracted)
        if i in of:
            groups[conversation, of[i], text[i]].append((extracted, i, evidence))
    active, want = {}, []
    for (conversation, key, value), cs in sorted(groups.items(), key=lambda g: (last[g[0][0]], g[0][0], g[1][0][:2])):
        times = [at[e] for c in cs for e in c[2] if e in at]
        b = active.get(key)
        if b is None or (b["value"] != value and key[3].startswith("single")):
            if b is not None:
                b["valid_to"] = min(times)
            b = active[key] = {"key": key[:3], "value": value, "valid_from": min(times), "valid_to": None, "observed_at": 0, "claims": [], "evidence": []}
            want.append(b)
        b["observed_at"] = max(b["observed_at"], *times)
        b["claims"] += [c[1] for c in cs]
        b["evidence"] += [e for c in cs for e in c[2] if e not in b["evidence"]]
    got = catalog.queries()["traced_beliefs"](spark, sf).collect()
    assert sorted(repr((r["subject_normalized"], r["predicate"], r["group_object_key"], r["value"], r["valid_from"], r["valid_to"], r["observed_at"], r["claim_ids"], r["evidence_ids"])) for r in got) == sorted(
        repr((*b["key"], b["value"], b["valid_from"], b["valid_to"], b["observed_at"], b["claims"], list(dict.fromkeys(b["evidence"])))) for b in want
    )


def test_only_the_latest_extraction_counts(spark):
    segments = spark.createDataFrame([("s", "c", "claude", True), ("old", "c", "claude", False)], "id string, conversation_id string, source_kind string, is_active boolean")
    extractions = spark.createDataFrame([("x1", "s", "extracted", 1), ("x2", "s", "extracted", 2), ("x3", "s", "failed", 3), ("x4", "old", "extracted", 1)], "id string, segment_id string, status string, created_at int")
    claims = spark.createDataFrame([(f"k{n}", "c", s, f"x{n}") for n, s in ((1, "s"), (2, "s"), (3, "s"), (4, "old"))], "id string, conversation_id string, segment_id string, extraction_id string")
    assert [r["id"] for r in C.active_claims(claims, segments, extractions).collect()] == ["k2"]
    assert sorted(r["id"] for r in C.active_claims(claims, segments).collect()) == ["k1", "k2", "k3"]


def test_neighbours_across_gaps_and_blocks(spark):
    from evidex.operators import segments as SG

    numbers = [0, 1, 5, 6, 11, 30]
    df = spark.createDataFrame([("c", n, 60, "same text") for n in numbers] + [("d", 7, 300, "alone")], "conversation_id string, segment int, tokens int, text string")
    r = E.fragmentation(df).first()
    assert (r["segments"], r["pairs"], r["tiny_pair_rate"], r["duplicate_pair_rate"]) == (7, 5, 1.0, 1.0)
    got = {(r["c"], r["n"]): r["next_n"] for r in SG.following(df.selectExpr("conversation_id c", "segment n"), "c", "n", ["n"], block=4).collect()}
    assert got == {**{("c", a): b for a, b in zip(numbers, [*numbers[1:], None])}, ("d", 7): None}


def test_every_hundredth_vector_is_a_query(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "similarity", "rank").collect()))
    ids = [r[0] for r in v.where("vec_id % 100 = 0").select("vec_id").collect()]
    assert len(ids) > 3
    got = rows(catalog.queries()["vector_top_k_hundreds"](spark, sf))
    assert got == rows(S.top_similar(v, ids, 5)) == rows(S.top_similar_to(v, v.where("vec_id % 100 = 0"), 5, block=2))


def test_a_window_around_every_evidence_message(spark, sf):
    con = duckdb.connect()
    messages = con.execute(f"select id, conversation_id, sequence_index, imported_at from '{sf}/messages.parquet' where sequence_index is not null").fetchall()
    at = {r[0]: r[1:3] for r in messages}
    last = {}
    for i, c, n, t in messages:
        if c is not None:
            last[c, n] = max(last.get((c, n), (t, i)), (t, i))
    want = []
    for claim, evidence in con.execute(f"select id, evidence_message_ids from '{sf}/claims.parquet'").fetchall():
        for e in set(evidence) & set(at):
            want += [(claim, e, last[at[e][0], at[e][1] + k][1], k) for k in range(-2, 3) if (at[e][0], at[e][1] + k) in last]
    assert sorted(map(tuple, catalog.queries()["evidence_context_windows"](spark, sf).collect())) == sorted(want)


def test_chains_longer_than_six(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    spark.range(50).select(F.format_string("%02d", "id").alias("id"), F.lit(ts("2025-01-01T00:00:00")).alias("recorded_at"), *(F.lit("k").alias(c) for c in ("subject_normalized", "predicate", "group_object_key"))).write.parquet(f"{tmp_path}/beliefs.parquet")
    got = catalog.queries()["belief_chain_heads"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(f"{n:02d}", "49") for n in range(49)]


def test_orphan_causes(spark):
    segments = spark.createDataFrame([("live", True, None), ("off", False, None), ("gone", False, ts("2025-01-01T00:00:00"))], "id string, is_active boolean, invalidated_at timestamp")
    claims = spark.createDataFrame([(s[0], s) for s in ("live", "off", "gone")], "id string, segment_id string")
    lost = spark.createDataFrame([("a", "l"), ("b", "l"), ("b", "o"), ("c", "o"), ("c", "g"), ("d", "?")], "belief_id string, claim_id string")
    got = {r["belief_id"]: r["cause"] for r in C.orphan_causes(lost, claims, segments).collect()}
    assert got == {"a": "reextraction", "b": "deactivated", "c": "reclassified", "d": "reextraction"}
