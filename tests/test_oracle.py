"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from check import compare, connect

from kelvingrid.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, QUERIES[name], ORACLES.get(name))
    assert ok is not False, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
