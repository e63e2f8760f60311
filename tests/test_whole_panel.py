"""The panel's raw tables hold every row of the given ones."""

import os

import pytest
from pyspark.sql import functions as F

from cityloom.plans.catalog_panel import raw_sources
from cityloom.plans.tables import Tables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_no_event_or_order_is_left_out(spark):
    t = Tables(spark, SF)
    s = raw_sources(t)
    assert s["weather"].count() == t.events.where("user_id IS NOT NULL").count()
    nations = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey").distinct().count()
    assert s["spend_daily"].select("city").distinct().count() == nations
