"""Small rows that lead to much work are dealt over tasks."""

import os

import pytest
from pyspark.sql import functions as F

from loomwright.operators import dealers
from loomwright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["page_cards", "vehicle_specs", "model_names", "structured_entities", "feed_records", "dealer_profiles"])
def test_rows_are_dealt(spark, name):
    """The one file of parts or suppliers is not one task's work."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan


def test_hours_are_read_once(spark):
    """The text of the hours is parsed for the week, not for each of its days."""
    df = spark.createDataFrame([("Mo-Fr 9am-6pm",)], "h string").select(dealers.opening_hours(F.col("h")).alias("w"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 20_000
    assert [(d.day, d.opens, d.closes, d.closed) for d in df.first().w][:2] == [(0, None, None, True), (1, "09:00:00", "18:00:00", False)]
