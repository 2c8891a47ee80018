"""Every query against its SQL on the same tables."""

import decimal

import duckdb
import pytest
from tables import TABLES

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if isinstance(v, decimal.Decimal) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    assert _sorted(rows) == _sorted(expected)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.total_source == 1500 and row.common + row.missing == row.total_source
