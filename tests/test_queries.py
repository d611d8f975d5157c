"""Every registered query against its SQL on the smallest sample."""

import compare
import pytest

from tallyforge.checks import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, connection, name):
    ok, note = compare.compare(spark, connection, SF_DIR, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
