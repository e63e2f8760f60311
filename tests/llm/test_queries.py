"""Registered queries against their SQL, and that each numbered operator has one."""

import os

import check
import pytest

from cityloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert check.compare([tuple(r) for r in df.collect()], df.columns, check.connect(SF), queries.ORACLES[name]) == "ok"


def test_classifier_on_held_out_rows(spark):
    scores = queries.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = scores.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held) > 50
