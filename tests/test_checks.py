"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from wayfold.plans.catalogue import CHECKS, QUERIES
from wayfold.plans.fixtures import TABLES

DATA = os.environ.get("WAYFOLD_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None or isinstance(value, bool) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in CHECKS:
        assert df.columns
        return
    cursor = duck.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(columns, cursor.fetchall())


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
