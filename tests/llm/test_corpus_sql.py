"""Corpus queries against their SQL."""

import duckdb
import pytest
from conftest import SF
from test_oracles import TABLES, ordered

from atlasloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    ours, theirs = QUERIES[name](spark, SF), sql.execute(ORACLES[name])
    assert ordered(ours.columns, ours.collect()) == ordered([d[0] for d in theirs.description], theirs.fetchall())
