"""Every query of the core library against its SQL in DuckDB, on the smallest data."""

import glob
import os

import duckdb
import pytest

from stylograph.plans.queries import QUERIES, SQL


def rows(df):
    def cell(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return ""
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return str(x)[:10] if hasattr(x, "isoformat") else int(x) if hasattr(x, "__index__") else x

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
