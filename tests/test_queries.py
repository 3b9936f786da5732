"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.9g}" if abs(v) < 1e15 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, oracle, name):
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    found = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    result = oracle.execute(SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    assert found == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
