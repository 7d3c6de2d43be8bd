"""Every registered query against its SQL on the smallest tables."""

import pytest

from entry_queries import ORACLES, QUERIES
from tests.side_by_side import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict = compare(spark, duck, name, SF_DIR)
    assert verdict.startswith("ok" if name in ORACLES else "rows only"), verdict
