"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), DATA) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 17 and {r.status for r in rows} == {"passed", "failed", "error"}
