"""Every behavioural family as a stream gives what its batch operator gives: several micro-batches, out of order, after a restart."""

import random

import pytest

from threatloom.operators import detectors
from threatloom.session import ship_package
from threatloom.streaming import families
from threatloom.streaming.replay import replayed

CONTACT = "event_id long, src string, dst string, qtype string, ts_iso string, epoch_s long"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def same(spark, frame, batch, stream, jitter_s=600, **replay):
    expected = batch(frame)
    streamed = replayed(frame, lambda s: stream(s, lateness=f"{2 * jitter_s} seconds"), jitter_s=jitter_s, **replay)
    if "shed" in streamed.columns:
        assert streamed.where("shed is not null").count() == 0
    columns = sorted(expected.columns)
    want = sorted(map(str, expected.select(columns).collect()))
    assert want and sorted(map(str, streamed.select(columns).collect())) == want


def contacts(spark, n, seed, pairs, steps):
    rng, at, rows = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        at += rng.choice(steps)
        rows.append((i, f"u{rng.randrange(pairs)}", f"d{rng.randrange(3)}.example.", rng.choice(["A", "TXT"]), f"iso-{i}", at))
    return spark.createDataFrame(rows, CONTACT)


def test_beacon(spark):
    frame = contacts(spark, 600, 1, 3, [0, 0, 20, 25, 30])
    options = {"min_events": 4, "tolerance_micros": 900_000, "min_median_s": 5}
    same(spark, frame, lambda f: detectors.beacon_periodicity(f, **options), lambda s, lateness: families.beacon_stream(s, lateness, **options))


def test_generated_names(spark):
    rng = random.Random(2)
    rows = [(i, "u", f"{''.join(rng.choice('abcdefgh012345') for _ in range(12)) if i % 3 else 'mail'}.example", "A", f"iso-{i}", 1_700_000_000 + 97 * i) for i in range(80)] * 2
    same(spark, spark.createDataFrame(rows, CONTACT), detectors.dga_likelihood, lambda s, lateness: families.dga_stream(s, lateness=lateness))


def test_tunnel(spark):
    rng, at, rows = random.Random(3), 1_700_000_000, []
    for i in range(500):
        at += rng.choice([0, 1, 5, 5, 200])
        label = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz012345") for _ in range(40)) if rng.random() < 0.7 else "www"
        rows.append((i, f"u{rng.randrange(2)}", f"{label}.t.example", rng.choice(["A", "TXT", None]), f"iso-{i}", at))
    options = {"window_queries": 30, "min_queries": 5, "min_avg_chars": 20, "idle_s": 190}
    same(spark, spark.createDataFrame(rows, CONTACT), lambda f: detectors.dns_tunneling(f, **options, chunk_s=60), lambda s, lateness: families.tunnel_stream(s, lateness=lateness, **options))


def test_flux(spark):
    rng, at, rows = random.Random(4), 1_700_000_000, []
    for i in range(300):
        at += rng.choice([0, 0, 300, 9000])
        rows.append((i, f"d{rng.randrange(3)}.example.", f"10.0.0.{rng.randrange(9)}", rng.randrange(100), f"iso-{i}", at))
    frame = spark.createDataFrame(rows, "event_id long, domain string, answer string, ttl int, ts_iso string, epoch_s long")
    same(spark, frame, detectors.fastflux_retained, lambda s, lateness: families.fastflux_stream(s, lateness))


def test_volume(spark):
    rng, at, rows = random.Random(5), 1_700_000_000, []
    for i in range(500):
        at += rng.choice([0, 0, 30, 500])
        rows.append((i, f"h{rng.randrange(2)}", f"d{rng.randrange(12)}", rng.choice([-5, 100, 1_000_000]), rng.choice([0, 10, 90_000]), f"iso-{i}", at))
    frame = spark.createDataFrame(rows, "event_id long, host string, dst string, out_bytes long, in_bytes long, ts_iso string, epoch_s long")
    options = {"min_bytes_out": 1_500_000, "min_diversity": 6}
    same(spark, frame, lambda f: detectors.volume_anomaly(f, **options), lambda s, lateness: families.volume_stream(s, lateness, **options))


def test_sync(spark):
    frame = contacts(spark, 400, 6, 6, [0, 1, 30, 400, 4000])
    options = {"ttl_s": 3600, "sync_window_s": 500, "min_hosts": 2}
    same(spark, frame, lambda f: detectors.sync_first_contact(f, **options), lambda s, lateness: families.sync_stream(s, lateness, **options))


def test_more_waiting_rows_than_the_capacity_are_shed_and_counted(spark):
    rows = [(i, "u", "d", "A", f"iso-{i}", 1_700_000_000 + 20 * i) for i in range(50)] + [(99, "v", "d", "A", "iso", 1_700_000_000)]
    out = replayed(spark.createDataFrame(rows, CONTACT), lambda s: families.beacon_stream(s, "1 hour", capacity=12, min_median_s=5), batches=1, files=1)
    found = out.collect()
    assert sum(r.shed or 0 for r in found) == 38
    assert [r.events for r in found if r.shed is None] == [6]
