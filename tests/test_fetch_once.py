"""The sequences of reference_fetch are made once and read from there."""

from spanloom.plans import models


def test_fetch_makes_the_bases_once(spark):
    plan = models.reference_fetch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "regexp_replace" not in plan
