"""Evidence is folded once for the score and for the counts of what was folded."""

import re

from threatloom.queries import decisions, frames

SMALL = "/root/testdata/sf0.001"


def test_both_readers_of_the_folded_evidence_ask_for_one_aggregate(spark):
    plan = decisions.decisions(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    folds = [line for line in plan.splitlines() if re.search(r"Aggregate \[indicator_id#\d+, identity#\d+, kind#\d+, observed_at#", line)]
    # The same keys and functions, so the exchange behind the partial aggregate is reused.
    assert len(folds) == 2 and all("min(struct(" in line and "count(1)" in line for line in folds), folds


def test_records_are_grouped_by_numbers(spark):
    plan = frames.evidence(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.search(r"Aggregate \[(.*?)\]", plan).group(1)
    assert "l_partkey" in keys and "indicator_id" not in keys, keys
