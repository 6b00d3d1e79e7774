"""Detectors over streams.

Stateless parsing and TLS checks run on a stream as they are. Ordered folds
wait for the watermark: a second is folded once no earlier event can arrive,
so a stream and a batch over the same events report the same detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatloom.sources.eve import parse_eve
from threatloom.streaming.ordered import OrderedFold, run_fold


def eve_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Parsed IDS events from a folder into which finished files are moved."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "line")
    # Order inside a second comes from the content, since a stream has no row numbers.
    return parse_eve(lines.withColumn("event_id", F.xxhash64("line")))


class FirstSeen(OrderedFold):
    """Per destination: the current window's anchor. Of a batch's events of one second only the first waits."""

    group = keys = ("dst",)
    row = "epoch_s long, event_id long, src string, ts_iso string"
    out = "src string, dst string, epoch_s long, observed_at string"

    def __init__(self, ttl_s: int, **bounds):
        super().__init__(**bounds)
        self.ttl_s = ttl_s

    def reduced(self, rows):
        return rows.drop_duplicates(["dst", "epoch_s"])

    def fold(self, key, rows):
        s, found = self.load(), []
        for at, _, src, ts_iso in rows:
            if not s or at > s["anchor"] + self.ttl_s:
                s = {"anchor": at}
                found.append((src, *key, at, ts_iso))
        self.save(s)
        self.wake(s["anchor"] + self.ttl_s)
        return found

    def idle(self, key, closed):
        if (s := self.load()) and closed > s["anchor"] + self.ttl_s:
            self.forget()                            # any event still to come starts a new window
        return []


def first_seen_stream(contacts: DataFrame, ttl_s: int = 86_400, lateness: str = "10 minutes") -> DataFrame:
    """Streaming form of first-seen novelty; needs the RocksDB state store."""
    return run_fold(contacts, FirstSeen(ttl_s), lateness).select("src", "dst", "epoch_s", "observed_at", F.timestamp_seconds("epoch_s").alias("at"))
