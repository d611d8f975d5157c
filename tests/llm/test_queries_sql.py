"""Registered queries against their SQL, and that every one runs."""

import compare
import pytest

from tallyforge.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    ok, note = compare.compare(spark, connection, SF_DIR, name)
    assert ok, note


def test_all_operators():
    assert sorted({int(name.split("_")[0][2:]) for name in QUERIES}) == list(range(1, 14))
