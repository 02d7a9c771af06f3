import glob
import os

import duckdb
import pytest

from stylograph.llm.queries import QUERIES, SQL

COLUMNS = {"p1_found": ["field", "doc_id", "sent_start", "sent_end"], "p3_found": ["field", "doc_id", "span_start", "span_end"], "p5_found": ["field", "doc_id_a", "doc_id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "seg_start", "lang"]}


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cells(rows):
    return sorted((tuple(round(float(x), 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, duck, name):
    made = QUERIES[name](spark, data)
    assert made.columns == COLUMNS.get(name, made.columns)
    rows = [tuple(r) for r in made.collect()]
    assert rows
    if name in SQL:
        want = duck.sql(SQL[name])
        assert cells(rows) == cells(want.project(", ".join(f'"{c}"' for c in made.columns)).fetchall())
