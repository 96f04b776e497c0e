"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def as_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(plain(row[at]) for at in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    found = entry_points.queries()[name](spark, FOLDER)
    wanted = database.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    rows = wanted.fetchall()
    types = {r[0]: r[1] for r in database.execute("DESCRIBE " + entry_points.oracle_sql()[name]).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == types
    assert as_rows(found.collect(), found.columns) == as_rows(rows, columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_runs_without_sql_only_where_none_fits():
    without = set(entry_points.queries()) - set(entry_points.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
