"""Every registered query against its SQL on the smallest scale factor."""

import importlib
import math
import os

import duckdb
import pytest

from codeloom.catalog import counts, graphs, sources, stored, texts, upkeep

entry = importlib.import_module("__spark_entry__")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


CORE = [counts.catalog, graphs.catalog, texts.catalog, upkeep.catalog, sources.catalog, stored.catalog]


def test_every_core_query_has_sql():
    for catalog in CORE:
        assert set(catalog.queries) == set(catalog.sql)
        assert set(catalog.queries) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(name for c in CORE for name in c.queries))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    expected = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, expected.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
