"""Registered queries against their SQL twins in DuckDB, at the smallest scale.

A spread over all families by default; RISKGRID_ALL_QUERIES=1 runs every one.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())
PICKED = NAMES if os.environ.get("RISKGRID_ALL_QUERIES") else NAMES[::3]


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def canonical(table):
    table = table.select(sorted(table.column_names))
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)
    return table.column_names, sorted(tuple(map(text, r)) for r in zip(*[c.to_pylist() for c in table.columns]))


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, data, oracle, name):
    ours = canonical(entry.queries()[name](spark, data).toArrow())
    theirs = canonical(oracle.sql(entry.oracle_sql()[name]).to_arrow_table())
    assert ours == theirs


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() == 10 and "risk_level" in out.columns
