"""Every query of the catalogue against its SQL."""

import os

import pytest

from axisframe import catalogue
from tests.oracle import connect, same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, con, name):
    same(con, catalogue.SQL[name], catalogue.QUERIES[name](spark, FOLDER))


def test_slice_sample_is_five_of_each_type(spark):
    out = catalogue.QUERIES["slice_sample"](spark, FOLDER)
    assert {r["count"] for r in out.groupBy("event_type").count().collect()} == {5}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
