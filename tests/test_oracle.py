"""Every query that has SQL gives the same rows on Spark and on the checking engine."""

import os

import pytest

import check
from cityloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert check.compare([tuple(r) for r in df.collect()], df.columns, check.connect(SF), catalog.ORACLES[name]) == "ok"
