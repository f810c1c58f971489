"""Every named query against its SQL in DuckDB, as sorted rows; those without SQL must give rows."""

import os

import duckdb
import pytest

from chronoreel import plans


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for n in os.listdir(data):
        c.sql(f"create view {n[:-8]} as select * from '{data}/{n}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return int(v) if isinstance(v, float) and v == int(v) else v


def sorted_rows(rows, cols):
    return sorted(str([plain(r[c]) for c in sorted(cols)]) for r in rows)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, data, duck, name):
    df = plans.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted_rows(rows, df.columns) == sorted_rows([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], df.columns)
