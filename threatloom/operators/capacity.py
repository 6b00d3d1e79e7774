"""Bounded detector state over batches: what a family of limited capacity would have seen, and what it shed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from threatloom.operators import scan
from threatloom.operators.detectors import BEHAVIORAL_PREFIX

# Key columns and tracked keys of each family. A full table either ignores new keys or stops the family.
LIMITS = {
    "beacon_periodicity": (("src", "dst"), 50_000, "ignore"),
    "dga_likelihood": (("dst",), 500_000, "stop"),
    "dns_tunneling": (("src",), 100_000, "stop"),
    "fastflux": (("domain",), 200_000, "stop"),
    "volume_anomaly": (("host", "dst"), 200_000, "stop"),
    "first_seen_novelty": (("dst",), 500_000, "stop"),
    "tls_metadata_mismatch": (("client", "dst"), 200_000, "stop"),
    "sync_first_contact": (("dst",), 100_000, "stop"),
}


def within_capacity(frame: DataFrame, keys: Sequence[str], capacity: int, full: str = "stop", chunk_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(events the family takes in, one health row) when at most ``capacity`` keys are tracked.

    Keys are taken in the order of their first event. With ``stop`` the first event of one key too many ends the intake; with
    ``ignore`` only events of keys beyond the capacity are left out. Health: tracked_keys, shed_keys, shed_events, degraded.
    Ranks come from running counts over time chunks, so no task holds all keys; only the instant of the stop reaches the driver.
    """
    keys = list(keys)
    firsts = frame.groupBy(*keys).agg(F.min(F.struct("epoch_s", "event_id")).alias("f"), F.count("*").alias("n")).select(*keys, "f.epoch_s", "f.event_id", "n", F.lit(1).alias("one"))
    ranked = scan.running_sums(firsts, [], "epoch_s", ["epoch_s", "event_id", *keys], {"place": "one"}, chunk_s)
    if full == "ignore":
        own = ranked.where(F.col("place") <= capacity).select(*[F.col(k).alias(f"_own_{k}") for k in keys])
        matches = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys]
        kept = frame.join(own, matches, "left_semi")
        late = F.col("place") > capacity
        health = ranked.agg(
            F.count_if(~late).alias("tracked_keys"), F.count_if(late).alias("shed_keys"),
            F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("shed_events"), F.coalesce(F.max(late), F.lit(False)).alias("degraded"))
        return kept, health
    stop = ranked.where(F.col("place") == capacity + 1).select("epoch_s", "event_id").first()
    if stop is None:
        return frame, ranked.agg(F.count("*").alias("tracked_keys"), F.lit(0).cast("long").alias("shed_keys"), F.lit(0).cast("long").alias("shed_events"), F.lit(False).alias("degraded"))
    before = (F.col("epoch_s") < stop["epoch_s"]) | ((F.col("epoch_s") == stop["epoch_s"]) & (F.col("event_id") < stop["event_id"]))
    shed = frame.agg(F.count_if(~before).alias("shed_events"))
    counts = ranked.agg(F.count_if(F.col("place") <= capacity).alias("tracked_keys"), F.count_if(F.col("place") > capacity).alias("shed_keys"))
    health = counts.withColumn("_one", F.lit(1)).join(shed.withColumn("_one", F.lit(1)), "_one").select("tracked_keys", "shed_keys", "shed_events", F.lit(True).alias("degraded"))
    return frame.where(before), health


def bounded_frames(frames: dict[str, DataFrame], capacities: dict[str, int] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each family's frame within its capacity, and a health row per family (kind, capacity, tracked_keys, ...)."""
    kept, rows = {}, None
    for family, frame in frames.items():
        keys, capacity, full = LIMITS[family]
        capacity = (capacities or {}).get(family, capacity)
        kept[family], health = within_capacity(frame, keys, capacity, full)
        row = health.select(F.lit(BEHAVIORAL_PREFIX + family).alias("kind"), F.lit(capacity).cast("long").alias("capacity"), "tracked_keys", "shed_keys", "shed_events", "degraded")
        rows = row if rows is None else rows.unionByName(row)
    return kept, rows
