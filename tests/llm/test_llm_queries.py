import pytest

from evidex.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
COLUMNS = {
    "p1_found": ["record_table", "record_id", "pii_kind", "start_pos"], "p3_found": ["cache_id_a", "cache_id_b"], "p5_found": ["conversation_id", "defect"],
    "p6_found": ["subject_a", "subject_b"], "p10_found": ["doc_id", "lang_found"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for t in ("messages", "conversations", "embedding_cache", "probe_vectors"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        r = con.execute(Q.oracle_sql()[name])
        have = [c[0] for c in r.description]
        assert sorted(repr(tuple(x[have.index(c)] for c in df.columns)) for x in r.fetchall()) == sorted(repr(tuple(x)) for x in rows)
