"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from atlasloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(columns, rows) -> list:
    """Rows in order of their text, columns by name, doubles to nine places."""
    plain = lambda x: "" if x is None else repr(round(x + 0.0, 9)) if isinstance(x, float) else str(x)
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(columns[i] for i in at), *sorted(tuple(plain(row[i]) for i in at) for row in rows)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    ours = QUERIES[name](spark, SF)
    theirs = sql.execute(ORACLES[name])
    assert ordered(ours.columns, ours.collect()) == ordered([d[0] for d in theirs.description], theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and out.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) <= set(__spark_entry__.queries())
