"""Every query that has SQL against DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import oracles, queries

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got[1]
    if name in oracles.ORACLE_SQL:
        result = duck.execute(oracles.ORACLE_SQL[name])
        assert got == table([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(oracles.ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
