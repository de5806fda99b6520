"""Every query with a SQL twin agrees with DuckDB (rows, names, values) at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, rows_of

from conftest import SF001


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    d_cols, d_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_every_query_has_a_callable_and_rows_only_ones_run(spark):
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    for name in sorted(set(qs) - set(E.oracle_sql())):
        assert qs[name](spark, SF001).count() > 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["user", "chunk", "t", "item", "target"]
    assert df.count() > 0
