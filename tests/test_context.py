"""Votes on the client and protocol of an indicator."""

from threatloom.operators import evidence


def test_records_are_counted_without_being_multiplied(spark):
    rows = [("a", "c2", "dns"), ("a", "c1", "dns"), ("a", " c1 ", "interactive_http"), ("a", "c2", "ssh"), ("a", "", "interactive_http"),
            ("b", None, " dns "), ("b", "", "dns"), ("b", "", "interactive_http"), ("c", "c9", "carrier-pigeon"), ("c", "c9", None), ("c", "c10", None),
            ("d", "", "carrier-pigeon"), ("d", None, None), ("e", None, "ssh"), ("e", None, "smtp"), ("f", "c1", "interactive_http")]
    found = evidence.observation_context(spark.createDataFrame(rows, "indicator_id string, client string, protocol_class string"))
    # Equal votes go to the smaller text; protocols that are not interactive, and those nobody knows, leave no class.
    assert {r.indicator_id: (r.client, r.protocol_class) for r in found.collect()} == {
        "a": ("c1", None), "b": (None, None), "c": ("c9", None), "e": (None, None), "f": ("c1", "interactive_http")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan, plan
