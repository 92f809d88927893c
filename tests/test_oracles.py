"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, views
from recordloom.plans.oracles import ORACLES
from recordloom.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(
    not os.path.isdir(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), reason="no tables"
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1
