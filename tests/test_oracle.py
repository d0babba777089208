"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest
from paths import SF_SMALL

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_registered_with_oracle_or_documented():
    rows_only = {q for q in set(QUERIES) - set(SQL) if q.startswith("q")}
    assert rows_only == {"q18_rougel"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(q for q in SQL if q.startswith("q")))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    od = con.sql(SQL[name]).df()
    assert sorted(sp.columns) == sorted(od.columns)
    assert len(sp) == len(od)
    assert digest(sp)[0] == digest(od)[0]
    for c in sp.columns:
        assert str(sp[c].dtype) == str(od[c].dtype), c


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} <= {"train", "dev", "test"}
    assert df.columns == ["split", "n_rows"]
