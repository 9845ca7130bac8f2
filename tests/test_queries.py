"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import documents, logs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def table(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(documents.QUERIES | logs.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = table(df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql}) x").fetchall()
        assert got == table(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
