"""Parts of a table that grow in number and not in size."""

from __future__ import annotations

from tallyforge.plans.feeds import s14_lineups
from tallyforge.shared import parts_for


def test_parts_follow_the_rows(spark):
    assert [parts_for(spark.range(n), rows=10) for n in (0, 40, 41, 1000)] == [4, 4, 5, 100]


def test_lineups_stay_in_the_parts_of_their_match(spark, sf_dir):
    plan = s14_lineups(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
