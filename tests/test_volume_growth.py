"""Destinations of a host are counted over whole seconds, not by sorting all its flows once more."""

import random

from threatloom.operators import detectors, scan
from threatloom.session import ship_package


def test_destinations_known_without_a_second_sort_of_the_flows(spark, monkeypatch):
    ship_package(spark)
    counted, plain = [], scan.running_sums
    monkeypatch.setattr(scan, "running_sums", lambda rows, *rest: counted.append(rows.columns) or plain(rows, *rest))
    draw = random.Random(4)
    # Seconds with several first contacts, also of the same event, and seconds with none.
    flows = [(f"h{k % 2}", f"d{draw.randrange(12)}", k // 3, 1_000 + k // 9 * 7, "t", 100, 1) for k in range(300)]
    flows = list(dict.fromkeys(flows))
    frame = spark.createDataFrame(flows, "host string, dst string, event_id long, epoch_s long, ts_iso string, out_bytes long, in_bytes long")
    found = detectors.volume_anomaly(frame, window_s=10_000, min_bytes_out=1, min_diversity=3)
    got = {(r.src, r.dst, r.event_id): r.host_distinct_dests for r in found.collect()}
    known, expected = {"h0": set(), "h1": set()}, {}
    for host, dst, event, at, *_ in sorted(flows, key=lambda r: (r[3], r[2], r[1])):
        known[host].add(dst)
        expected[host, dst, event] = len(known[host])
    assert got == expected
    assert not any("event_id" in columns for columns in counted)
