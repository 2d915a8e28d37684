"""Every query of the library against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from pulsegrid import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got
    if name in Q.ORACLE_SQL:
        r = duck.sql(Q.ORACLE_SQL[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


def test_entry_point_has_all(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["session_id", "timestamp_s", "channel", "kind", "value"]
