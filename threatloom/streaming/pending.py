"""Detections that wait, bounded in time and number, for their target to become a known indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatloom.streaming.ordered import OrderedFold, run_fold


class Pending(OrderedFold):
    """Per target: the indicator that names it, and at most ``depth`` waiting detections, oldest first.

    In the order of event time: an indicator releases all that wait, in the order they came; a detection of a known target goes
    straight through; one that has waited longer than ``wait_s`` expires; one too many drops the oldest. Indicators come before
    detections of the same second. The first indicator of a target stays.
    """

    group = keys = ("target",)
    order = 3
    row = "epoch_s long, rank long, entry_id long, kind string, src string, observed_at string, indicator_id string"
    out = "target string, entry_id long, kind string, src string, epoch_s long, observed_at string, indicator_id string, outcome string, settled_s long"

    def __init__(self, wait_s: int = 900, depth: int = 64, **bounds):
        super().__init__(**bounds)
        self.wait_s, self.depth = wait_s, depth

    def _settled(self, key, entry, indicator_id, outcome, second) -> tuple:
        at, entry_id, kind, src, observed_at = entry
        return (*key, entry_id, kind, src, at, observed_at, indicator_id, outcome, second)

    def _expired(self, key, queue: list[tuple], now: int) -> list[tuple]:
        """Take from the queue what has waited too long by ``now``."""
        n = next((k for k, entry in enumerate(queue) if entry[0] + self.wait_s >= now), len(queue))
        gone, queue[:n] = queue[:n], []
        return [self._settled(key, e, None, "expired", e[0] + self.wait_s) for e in gone]

    def _keep_state(self, s: dict, queue: list[tuple]) -> None:
        if s or queue:
            self.save({**s, "queue": queue})
        else:
            self.forget()
        if queue:
            self.wake(queue[0][0] + self.wait_s)

    def _state(self) -> tuple[dict, list[tuple]]:
        s = self.load()
        return s, [tuple(e) for e in s.pop("queue", [])]

    def fold(self, key, rows):
        (s, queue), found = self._state(), []
        for at, rank, entry_id, kind, src, observed_at, indicator_id in rows:
            found += self._expired(key, queue, at)
            if not rank:
                s = s or {"indicator_id": indicator_id}
                found += [self._settled(key, e, s["indicator_id"], "attached", at) for e in queue]
                queue = []
                continue
            entry = (at, entry_id, kind, src, observed_at)
            if s:
                found.append(self._settled(key, entry, s["indicator_id"], "attached", at))
                continue
            if len(queue) >= self.depth:
                found.append(self._settled(key, queue.pop(0), None, "overflow", at))
            queue.append(entry)
        self._keep_state(s, queue)
        return found

    def idle(self, key, closed):
        s, queue = self._state()
        found = self._expired(key, queue, closed)
        if found or queue:
            self._keep_state(s, queue)
        return found


def pending_stream(detections: DataFrame, indicators: DataFrame, wait_s: int = 900, depth: int = 64, lateness: str = "10 minutes", **bounds) -> DataFrame:
    """(target, entry_id, kind, src, epoch_s, observed_at, indicator_id, outcome, settled_s, shed) of every detection, once it is settled.

    ``detections``: target, entry_id, kind, src, epoch_s, observed_at. ``indicators``: value, indicator_id, seen_s. Outcomes:
    attached (with the indicator), expired, overflow; the last two count the evictions.
    """
    return run_fold(entries(detections, indicators), Pending(wait_s, depth, **bounds), lateness)


def entries(detections: DataFrame, indicators: DataFrame) -> DataFrame:
    """Both sides as rows of one stream; entries of one second are ordered by ``rank`` and ``entry_id``."""
    left = detections.selectExpr("target", "epoch_s", "1L as rank", "entry_id", "kind", "src", "observed_at", "cast(null as string) as indicator_id")
    right = indicators.select(
        F.col("value").alias("target"), F.col("seen_s").alias("epoch_s"), F.lit(0).cast("long").alias("rank"), F.xxhash64("indicator_id").alias("entry_id"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("observed_at"), "indicator_id")
    return left.unionByName(right)
