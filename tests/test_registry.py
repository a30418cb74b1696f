"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert rows
    sql = oracle_sql().get(name)
    if sql is not None:
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert rows == sorted(duck.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=str)


def test_all_oracles_have_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, sf):
    df = entry(spark)
    assert df.columns and not df.isEmpty()
