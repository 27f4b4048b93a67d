"""The registered queries that SQL can restate, against it."""

import glob
import os

import duckdb
import pytest

from corpusspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())


@pytest.mark.parametrize("name", ["p1_pieces", "p2_found", "p3_found", "p4_found", "p5_classes", "p6_pack", "p8_records"])
def test_rows(spark, sf_dir, name):
    folder = "/root/testdata/sf0.01" if name == "p3_found" else sf_dir  # the smallest tables have seven labels
    assert queries.queries()[name](spark, folder).count() > 0
