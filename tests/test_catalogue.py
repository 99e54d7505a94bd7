"""Every registered query of the engine against DuckDB, and the contract of the entry file."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalogue
from sparkloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.collect(), df.columns)
    assert name in catalogue.ORACLES
    cur = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(cur.fetchall(), columns)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    here = os.path.dirname(os.path.abspath(entry.__file__))
    assert ("pipeline" in entry.queries()) == os.path.exists(f"{here}/corpus_pipeline.py")
