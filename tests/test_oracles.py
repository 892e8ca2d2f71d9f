"""Every query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from veriframe.queries import ORACLE_SQL, QUERIES


def cell(v):
    if isinstance(v, (float, Decimal)):
        return ("number", round(float(v), 5))
    return (type(v).__name__, str(v))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())
