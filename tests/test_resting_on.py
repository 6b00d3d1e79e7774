"""A source's effect is worked out on the indicators it touches."""

from threatloom.operators import analytics


def test_only_touched_indicators_and_all_their_evidence(spark):
    indicators = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "indicator_id string")
    evidence = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "t"), (4, "c", "s"), (5, "c", "s"), (6, "d", None), (7, None, "s")],
                                     "evidence_id long, indicator_id string, source_id string")
    own, about = analytics.resting_on(indicators, evidence, "s")
    assert sorted(r.indicator_id for r in own.collect()) == ["a", "c"]
    assert sorted(r.evidence_id for r in about.collect()) == [1, 2, 4, 5]
    assert own.columns == indicators.columns and about.columns == evidence.columns
