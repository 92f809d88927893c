"""Queries that SQL can express, against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from compare import compare, views
from recordloom.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), reason="no tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, name):
    assert compare(spark, views(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) is None
