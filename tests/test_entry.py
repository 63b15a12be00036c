"""The driver contract, and every query with SQL against an independent engine."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import queries as plans


def same(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, data, tables, name):
    got = plans.queries()[name](spark, data)
    found = tables.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert same([r.asDict() for r in got.collect()], sorted(names)) == same(want, sorted(names))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
