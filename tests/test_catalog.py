"""Every catalog query against its SQL on the smallest tables."""

import pytest

from msgrisk.catalog import ORACLE, QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Model fitting is exercised on a small fixture in test_training.
SLOW = {"out_of_fold_scores", "tabular_importances"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
