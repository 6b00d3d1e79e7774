"""Detections meeting indicators that arrive before or after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_stream(detections: DataFrame, indicators: DataFrame, wait_s: int = 900, lateness: str = "5 minutes") -> DataFrame:
    """Left outer stream-stream join on the target within ``wait_s`` of event time.

    ``detections``: target, kind, epoch_s, observed_at. ``indicators``: value,
    indicator_id, seen_s (when it became known; a static snapshot joins by
    ``attach_known`` first). An unmatched detection comes out with a null
    indicator once its wait is over, which is the expiry of a pending one.
    """
    left = detections.withColumn("det_at", F.timestamp_seconds("epoch_s")).withWatermark("det_at", lateness)
    right = indicators.select(F.col("value").alias("known"), "indicator_id", F.timestamp_seconds("seen_s").alias("ind_at")) \
        .withWatermark("ind_at", lateness)
    soon = F.expr(f"target = known AND ind_at >= det_at AND ind_at <= det_at + interval {int(wait_s)} seconds")
    return left.join(right, soon, "leftOuter").drop("known")


def attach_known(detections: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stream-static join against the current indicator table."""
    return detections.join(snapshot.select(F.col("value").alias("target"), "indicator_id"), "target")
