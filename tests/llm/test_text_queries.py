import glob
import os

import pytest

from factloom.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for p in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        cursor = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.ORACLES[name]})")
        assert got == sorted(cursor.fetchall(), key=repr)


def test_found_columns(spark, sf):
    for name, columns in (("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id"])):
        assert queries.QUERIES[name](spark, sf).columns == columns
