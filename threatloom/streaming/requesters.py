"""Requester correlation state over a stream of transactions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.digest import handle_for
from threatloom.functions.instants import parse_instant
from threatloom.operators.correlation import features, fingerprint
from threatloom.streaming.ordered import OrderedFold, run_fold


class Requester(OrderedFold):
    """Per handle: the newest value of each feature, the number of transactions and the last sighting.

    Equal instants are settled by the greater value. A handle that is silent for more than ``ttl_s`` is forgotten, which is reported
    once the watermark shows it; a later transaction starts it anew. Every report has the watermark's second as its version.
    """

    group = keys = ("handle",)
    order = 3
    row = "epoch_s long, at long, observed_at string, values string"
    out = "handle string, values string, transactions long, last_seen string, version long, removed boolean"

    def __init__(self, ttl_s: int, **bounds):
        super().__init__(**bounds)
        self.ttl_s = ttl_s

    def fold(self, key, rows):
        s, gone = self.load(), []
        for _, at, observed_at, values in rows:
            if s and at - s["at"] > self.ttl_s * 1_000_000:
                gone.append(self._removal(key, s))
                s = {}
            known = s.get("newest", {})
            for feature, value in json.loads(values).items():
                if feature not in known or [at, value] > known[feature]:
                    known[feature] = [at, value]
            s = {"at": at, "seen": observed_at, "n": s.get("n", 0) + 1, "newest": known}
        self.save(s)
        self.wake(s["at"] // 1_000_000 + self.ttl_s)
        values = json.dumps({k: v[1] for k, v in s["newest"].items()})
        return [*gone, (*key, values, s["n"], s["seen"], rows[-1][0], False)]

    def _removal(self, key, s: dict) -> tuple:
        return (*key, None, None, s["seen"], s["at"] // 1_000_000 + self.ttl_s, True)

    def idle(self, key, closed):
        s = self.load()
        if not s or closed <= s["at"] // 1_000_000 + self.ttl_s:
            return []
        self.forget()
        return [self._removal(key, s)]


def admitted(transactions: DataFrame, key: bytes | None, ttl_s: int, now: Column | None = None) -> DataFrame:
    """(handle, epoch_s, at, observed_at, values) of the transactions with features and a readable instant.

    ``now`` is the time of intake: what lies more than ``ttl_s`` ahead of it is refused, else one row would move the watermark past
    everything.
    """
    handle = handle_for(F.col("client_ref"), key) if key is not None else F.col("client_ref")
    seen = transactions.select(handle.alias("handle"), "observed_at", F.unix_micros(parse_instant(F.col("observed_at"))).alias("at"), features().alias("found")) \
        .where((F.size("found") > 0) & F.col("at").isNotNull())
    if now is not None:
        seen = seen.where(F.col("at") <= F.unix_micros(now) + ttl_s * 1_000_000)
    return seen.select("handle", F.expr("at div 1000000").alias("epoch_s"), "at", "observed_at", F.to_json("found").alias("values"))


def requesters_stream(transactions: DataFrame, key: bytes | None, ttl_s: int, now: Column | None = None, lateness: str = "10 minutes", **bounds) -> DataFrame:
    """Streaming ``requester_states``: a new version of a handle's state whenever it changed, and its removal."""
    return run_fold(admitted(transactions, key, ttl_s, now), Requester(ttl_s, **bounds), lateness)


def current_requesters(versions: DataFrame) -> DataFrame:
    """(handle, features, transactions, last_seen, fingerprint) of the handles whose latest version is not a removal."""
    latest = versions.where("shed is null").groupBy("handle").agg(F.max(F.struct("version", "removed", "transactions", "last_seen", "values")).alias("v")) \
        .where("not v.removed").select("handle", F.from_json("v.values", "map<string,string>").alias("features"), "v.transactions", "v.last_seen")
    return latest.withColumn("fingerprint", fingerprint(F.col("features")))
