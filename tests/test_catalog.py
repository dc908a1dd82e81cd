"""Every query against its SQL on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from evidex.plans import catalog, derivation, imports, problems, serving  # noqa: F401 - derivation, imports and serving add their queries to the catalogue

QUERIES = {**problems.queries(), **catalog.queries()}
SQL = {**problems.oracle_sql(), **catalog.oracle_sql()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return round(float(v), 5) if hasattr(v, "is_finite") else v


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    got, cols = df.collect(), sorted(df.columns)
    if name in SQL:
        r = tables.execute(SQL[name])
        have = [c[0] for c in r.description]
        assert sorted(have) == cols
        want = sorted(repr(tuple(plain(x[have.index(c)]) for c in cols)) for x in r.fetchall())
        assert sorted(repr(tuple(plain(x[c]) for c in cols)) for x in got) == want
