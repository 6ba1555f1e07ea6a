"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from crawlweave import catalog
from oracle import compare, connect

FOLDER = os.environ.get("CATALOG_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    result = catalog.QUERIES[name](spark, FOLDER)
    ok, note = compare(result, con, catalog.ORACLES[name])
    assert ok, note


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "rank", "tier", "url", "snippet"]
    assert found.count() > 0
