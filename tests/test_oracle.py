"""Every registered query runs, and agrees with its SQL."""

import os

import pytest

from tests.oracle import connect, differences
from vantage import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"G02_components", "R10_near_duplicates"}  # iterative: tested on small frames in test_operators


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert differences(df, con, catalog.ORACLES[name]) == ""
    else:
        df.collect()
