"""Every query against its SQL counterpart, on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as driver
from beaconaudit.derived import TABLES
from beaconaudit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
CHECKED = sorted(QUERIES)


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, other, name):
    frame = driver.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = collections.Counter(tuple(r) for r in frame.select(*columns).collect())
    result = other.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["project_name", "data_category", "operation_type", "findings", "files"]
    assert frame.count() > 0


def test_every_counterpart_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
