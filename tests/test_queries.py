"""Every registered query of the core against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from corpusspark.plans import registry


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, tables, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = tables.execute(sql)
    columns = sorted(c[0] for c in result.description)
    assert columns == sorted(df.columns)
    place = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in place) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == expected


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
