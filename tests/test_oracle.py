"""Every query with an SQL twin gives the twin's rows on the smallest data."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(table):
    names = sorted(table.schema.names)

    def cell(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    columns = [[cell(v) for v in table[n].to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, duck, name):
    ours = rows_of(QUERIES[name](spark, SF).toArrow())
    theirs = rows_of(duck.execute(TWINS[name]).to_arrow_table())
    assert ours == theirs


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
