"""The behavioural families as streams. Each reports what its batch operator reports over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatloom.functions import text
from threatloom.functions.instants import iso_of_epoch
from threatloom.operators import detectors
from threatloom.operators.detectors import DAY_S
from threatloom.streaming.detect import first_seen_stream
from threatloom.streaming.ordered import Members, OrderedFold, run_fold


def _near(gaps: list[int], low: int, high: int, tolerance: int) -> int | None:
    """The median, if it lies in the bounds and every gap near it."""
    ordered, n = sorted(gaps), len(gaps)
    median = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) // 2
    if not low <= median <= high:
        return None
    return median if max(ordered[-1] - median, median - ordered[0]) * 1_000_000 // median <= tolerance else None


class Beacon(OrderedFold):
    """Per pair: first and last sighting, the last gaps (a ring of ``min_events`` + 64), and how many there were."""

    group = keys = ("src", "dst")
    row = "epoch_s long, event_id long, ts_iso string"
    out = "src string, dst string, epoch_s long, observed_at string, first_seen string, events long, median_gap_s long"

    def __init__(self, min_events: int = 6, tolerance_micros: int = 250_000, min_median_s: int = 10, max_median_s: int = 3600, **bounds):
        super().__init__(**bounds)
        self.min_events, self.limits = min_events, (min_median_s, max_median_s, tolerance_micros)

    def fold(self, key, rows):
        s, found = self.load(), []
        for at, _, ts_iso in rows:
            if not s:
                s = {"first": ts_iso, "last": at, "gaps": [], "total": 0, "told": 0}
            gap = at - s["last"]
            if not gap:
                continue
            s["last"], s["total"] = at, s["total"] + 1
            s["gaps"] = [*s["gaps"], gap][-(self.min_events + 64):]
            if s["total"] - s["told"] >= self.min_events and (median := _near(s["gaps"], *self.limits)) is not None:
                s["told"] = s["total"]
                found.append((*key, at, ts_iso, s["first"], len(s["gaps"]), median))
        self.save(s)
        return found


def beacon_stream(contacts: DataFrame, lateness: str = "10 minutes", **options) -> DataFrame:
    """Streaming ``beacon_periodicity``."""
    return run_fold(contacts, Beacon(**options), lateness)


def dga_stream(queries: DataFrame, ttl_s: int = DAY_S, lateness: str = "10 minutes", **bands) -> DataFrame:
    """Streaming ``dga_likelihood``: windows of first sightings, then the name's structure."""
    named = queries.withColumn("dst", text.strip_dots(F.col("dst"))).where("dst <> ''")
    first = first_seen_stream(named, ttl_s, lateness).withColumnRenamed("observed_at", "ts_iso")
    return detectors.generated_names(first, **bands)


class Tunnel(OrderedFold):
    """Per client: the current block's counts, which start anew after ``window_queries`` queries or ``idle_s`` of silence."""

    group = keys = ("src",)
    row = "epoch_s long, event_id long, ts_iso string, chars long, long_label boolean, data_type boolean"
    out = "src string, event_id long, epoch_s long, observed_at string, queries long, share_micros long, avg_label_chars long, data_type_queries long"

    def __init__(self, window_queries: int = 200, min_queries: int = 40, min_share_micros: int = 350_000, min_avg_chars: int = 60, idle_s: int = 3600, **bounds):
        super().__init__(**bounds)
        self.window, self.least, self.idle_s = window_queries, (min_queries, min_share_micros, min_avg_chars), idle_s

    def fold(self, key, rows):
        s, found = self.load(), []
        for at, event_id, ts_iso, chars, long_label, data_type in rows:
            if not s or at - s["last"] > self.idle_s or s["queries"] == self.window:
                s = {"queries": 0, "long": 0, "chars": 0, "data": 0}
            s = {"last": at, "queries": s["queries"] + 1, "long": s["long"] + bool(long_label), "chars": s["chars"] + (chars or 0), "data": s["data"] + bool(long_label and data_type)}
            n = s["queries"]
            share, average = s["long"] * 1_000_000 // n, s["chars"] // n
            if n < self.window and all(have >= least for have, least in zip((n, share, average), self.least)):
                found.append((*key, event_id, at, ts_iso, n, share, average, s["data"]))
        self.save(s)
        self.wake(s["last"] + self.idle_s)
        return found

    def idle(self, key, closed):
        if (s := self.load()) and closed > s["last"] + self.idle_s:
            self.forget()                            # a later query starts a new block anyway
        return []


def tunnel_stream(queries: DataFrame, label_len: int = 24, high_microbits: int = 3_100_000, lateness: str = "10 minutes", **options) -> DataFrame:
    """Streaming ``dns_tunneling``; labels are measured before anything is kept."""
    return run_fold(detectors.label_signals(queries, label_len, high_microbits), Tunnel(**options), lateness)


class Flux(OrderedFold):
    """Per domain: the answers seen, and a retained list cut to its last ``keep`` answers once its head is too old."""

    group, keys, order = ("domain",), ("dst",), 3
    row = "epoch_s long, event_id long, answer string, ttl long, ts_iso string"
    out = "dst string, event_id long, answer string, epoch_s long, observed_at string, first_seen_s long, events long, distinct_answers long, avg_ttl long"

    def __init__(self, min_distinct: int = 5, min_answers: int = 8, ttl_s: int = DAY_S, keep: int = 8, **bounds):
        super().__init__(**bounds)
        self.least, self.ttl_s, self.keep = (min_distinct, min_answers), ttl_s, keep

    def open(self, handle):
        self.answers = Members(handle, "answers")

    def fold(self, key, rows):
        s = self.load() or {"count": 0, "head": 1, "head_at": rows[0][0], "ttl": 0, "distinct": 0, "recent": []}
        found, known = [], set()
        for at, event_id, answer, ttl, ts_iso in rows:
            s["distinct"] += self.answers.add(self, s, known, answer)
            s["count"], s["ttl"] = s["count"] + 1, s["ttl"] + (ttl or 0)
            s["recent"] = [*s["recent"], at][-self.keep:]
            first_kept = max(s["head"], s["count"] - self.keep + 1)
            if at - s["head_at"] > self.ttl_s and first_kept != s["head"]:
                s["head"], s["head_at"] = first_kept, s["recent"][first_kept - s["count"] - 1]
            events = s["count"] - s["head"] + 1
            if s["distinct"] >= self.least[0] and events >= self.least[1]:
                found.append((*key, event_id, answer, at, ts_iso, s["head_at"], events, s["distinct"], s["ttl"] // events))
        self.save(s)
        return found


def fastflux_stream(answers: DataFrame, lateness: str = "10 minutes", **options) -> DataFrame:
    """Streaming ``fastflux_retained``."""
    named = answers.withColumn("domain", text.strip_dots(F.col("domain"))).where("domain <> ''").withColumn("ttl", F.col("ttl").cast("long"))
    found = run_fold(named, Flux(**options), lateness)
    return found.withColumn("first_seen", iso_of_epoch(F.col("first_seen_s"))).drop("first_seen_s")


class Volume(OrderedFold):
    """Per host: its destinations, each with the open window's start and bytes and the destinations known before it opened."""

    group, keys, order = ("host",), ("src",), 3
    row = "epoch_s long, event_id long, dst string, out_bytes long, in_bytes long, ts_iso string"
    out = "src string, dst string, event_id long, epoch_s long, observed_at string, bytes_out long, bytes_in long, inversion boolean, focused boolean, host_distinct_dests long"

    def __init__(self, window_s: int = 3600, min_bytes_out: int = 10 * 1024 * 1024, min_diversity: int = 8, inversion: bool = True, **bounds):
        super().__init__(**bounds)
        self.window_s, self.min_out, self.diversity, self.inversion = window_s, min_bytes_out, min_diversity, inversion

    def open(self, handle):
        self.pairs = handle.getMapState("pairs", "id string, dst string", "opened boolean, start long, sent long, got long, prior long")

    def fold(self, key, rows):
        s, found = self.load() or {"dests": 0}, []
        touched: dict[str, tuple] = {}
        for at, event_id, dst, sent, got, ts_iso in rows:
            pair = touched.get(dst) or self.pairs.getValue((self.id, dst))
            new = pair is None
            s["dests"] += new
            opened, start, out_sum, in_sum, prior = pair or (False, 0, 0, 0, 0)
            if opened and at - start > self.window_s:
                touched[dst] = (False, 0, 0, 0, 0)   # the flow that closes a window is not counted
                continue
            if not opened:
                start, out_sum, in_sum, prior = at, 0, 0, s["dests"] - new
            out_sum, in_sum = out_sum + max(0, sent or 0), in_sum + max(0, got or 0)
            touched[dst] = (True, start, out_sum, in_sum, prior)
            if out_sum >= self.min_out:
                inverted = self.inversion and 0 < in_sum and out_sum > in_sum * 5
                focused = self.diversity > 1 and prior >= self.diversity
                if inverted or focused:
                    found.append((*key, dst, event_id, at, ts_iso, out_sum, in_sum, inverted, focused, s["dests"]))
        for dst, pair in touched.items():
            self.pairs.updateValue((self.id, dst), pair)
        self.save(s)
        return found


def volume_stream(flows: DataFrame, lateness: str = "10 minutes", **options) -> DataFrame:
    """Streaming ``volume_anomaly``."""
    return run_fold(flows, Volume(**options), lateness)


class Sync(OrderedFold):
    """Per destination: the anchor of its window and the hosts that joined within the first ``sync_window_s``."""

    group = keys = ("dst",)
    row = "epoch_s long, event_id long, src string, ts_iso string"
    out = "dst string, event_id long, epoch_s long, observed_at string, first_seen string, distinct_hosts long"

    def __init__(self, ttl_s: int = DAY_S, sync_window_s: int = 300, min_hosts: int = 3, **bounds):
        super().__init__(**bounds)
        self.ttl_s, self.sync_s, self.min_hosts = ttl_s, sync_window_s, min_hosts

    def open(self, handle):
        self.hosts = Members(handle, "hosts")

    def fold(self, key, rows):
        s, found, known = self.load(), [], set()
        for at, event_id, src, ts_iso in rows:
            if not s or at > s["anchor"] + self.ttl_s:
                self.hosts.clear(self, s)
                s, known = {"anchor": at, "first": ts_iso, "hosts": 0}, set()
            if at > s["anchor"] + self.sync_s:
                continue
            s["hosts"] += self.hosts.add(self, s, known, src)
            if s["hosts"] >= self.min_hosts:
                found.append((*key, event_id, at, ts_iso, s["first"], s["hosts"]))
        self.save(s)
        self.wake(s["anchor"] + self.ttl_s)
        return found

    def idle(self, key, closed):
        if (s := self.load()) and closed > s["anchor"] + self.ttl_s:
            self.hosts.clear(self, s)
            self.forget()                            # a later contact starts a new window anyway
        return []


def sync_stream(contacts: DataFrame, lateness: str = "10 minutes", **options) -> DataFrame:
    """Streaming ``sync_first_contact``."""
    named = contacts.withColumn("dst", text.strip_dots(F.col("dst"))).where("dst <> ''")
    return run_fold(named, Sync(**options), lateness)
