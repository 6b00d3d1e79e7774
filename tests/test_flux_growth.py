"""Answers of the retained fast-flux list are shuffled once for all their uses, and meet their first sightings without a join."""

import re

from pyspark.sql import functions as F

from threatloom.operators import detectors
from threatloom.session import ship_package


def test_answers_are_shuffled_once_and_a_repeated_first_sighting_is_one_answer(spark):
    ship_package(spark)
    at = 1_700_000_000
    rows = [(k, "d.example", f"10.0.0.{k // 2 % 6}", 5, f"iso-{k // 4}", at + k // 4) for k in range(60)]
    rows += [(0, "d.example", "10.0.0.0", 7, "iso-0", at), (61, "d.example", None, 5, "iso-3", at + 3), (62, ".", "10.0.0.1", 5, "iso-3", at + 3)]
    frame = spark.createDataFrame(rows, "event_id long, domain string, answer string, ttl long, ts_iso string, epoch_s long") \
        .groupBy("event_id", "domain", "answer", "ts_iso", "epoch_s", "ttl").agg(F.count("*").alias("n")).drop("n")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = detectors.fastflux_retained(frame)
        got = {(r.event_id, r.answer, r.avg_ttl): (r.events, r.distinct_answers) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    seen, expected, ttl, ordered = set(), {}, 0, sorted((r for r in rows if r[1] != "."), key=lambda r: (r[5], r[0], r[2] or "", r[3]))
    for n, r in enumerate(ordered, 1):
        seen |= {r[2]} - {None}
        ttl += r[3]
        if n >= 8 and len(seen) >= 5:
            expected[r[0], r[2], ttl // n] = (n, len(seen))
    assert got == expected and len(got) > 40
    written = [line for line in plan.splitlines() if re.search(r"(?<!Reused)Exchange hashpartitioning", line) and "ReusedExchange" not in line]
    assert len(written) <= 6, plan
