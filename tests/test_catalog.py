"""Each query against its SQL over the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__
from oakloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Queries that have no rows over the smallest tables.
EMPTY = {"list_page", "every_n_steps", "register_invalid"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    found = catalog.queries()[name](spark, FOLDER)
    expected = engine.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    rows = expected.fetchall()
    assert rows or name in EMPTY
    assert ordered(found.select(*columns).collect()) == ordered(rows)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows_without_nulls(spark, name):
    rows = catalog.queries()[name](spark, FOLDER).collect()
    assert rows and not any(v is None for r in rows for v in r)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
