"""Waiting rows are merged piece by piece, whatever order they came in, and entries of keys are read and written a page at a time."""

import json
import random

import pandas as pd

from threatloom.streaming import families, ordered


class Store(dict):
    """A map or value state that counts its calls."""

    calls = 0

    def getValue(self, k):
        self.calls += 1
        return self.get(k)

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def removeKey(self, k):
        self.calls += 1
        self.pop(k, None)

    def containsKey(self, k):
        return k in self

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return 0 in self

    def get(self, k=0, default=None):
        return super().get(k, default)

    def update(self, v):
        self[0] = v

    def clear(self):
        self.pop(0, None)


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Store())

    getValueState = getMapState

    def registerTimer(self, _):
        pass


class Times:
    def __init__(self, second):
        self.second = second

    def getCurrentWatermarkInMs(self):
        return self.second * 1000


def opened(fold):
    fold.init(Handle())
    return fold


def frames(fold, rows, size):
    names = [*ordered.names_of(fold.row), *fold.group]
    return iter([pd.DataFrame(rows[k: k + size], columns=names) for k in range(0, len(rows), size)])


def results(found):
    return sorted(tuple(r) for frame in found for r in frame.drop(columns="shed").itertuples(index=False))


def test_a_busy_key_is_merged_with_few_pieces_in_memory(monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", 20)
    monkeypatch.setattr(ordered, "RUN", 200, raising=False)
    monkeypatch.setattr(ordered, "FAN", 3, raising=False)
    draw = random.Random(5)
    rows = [(at, n, f"d{n % 7}", 10, 1, "t", "h") for n, at in enumerate(draw.randrange(5_000) for _ in range(4_000))]
    fold = opened(families.Volume(window_s=50, min_bytes_out=1, min_diversity=2))
    assert list(fold.handleInputRows(None, frames(fold, rows, 50), None)) == []
    inside, most, plain = [0], [0], fold.pieces.getValue

    def load(place):
        found = plain(place)
        inside[0] += len(json.loads(found[0]))
        most[0] = max(most[0], inside[0])
        return found

    def store(place, value):
        inside[0] -= len(json.loads(value[0]))
        fold.pieces[place] = value

    monkeypatch.setattr(fold.pieces, "getValue", load)
    monkeypatch.setattr(fold.pieces, "updateValue", store)
    out = []
    for row in fold._due(4_000):
        inside[0] -= 1
        out.append(row)
    assert out == sorted(r for r in rows if r[0] < 4_000)
    assert most[0] <= 200                            # of 3,200 rows
    assert list(fold._due(5_000)) == sorted(r for r in rows if r[0] >= 4_000)


def test_calls_to_the_store_are_paid_for_pages(monkeypatch):
    """Thousands of keys of a bucket, in two batches: calls stay far below the keys, with the results of keys on their own."""
    draw = random.Random(6)
    rows = [(1_000 + n // 10, n, f"10.0.0.{draw.randrange(9)}", 5, "t", f"d{draw.randrange(2_000)}") for n in range(40_000)]
    fold, found = opened(families.Flux()), []
    for part, closed in ((rows[:20_000], 3_000), (rows[20_000:], 9_000)):
        found += fold.handleInputRows(None, frames(fold, part, 10_000), None)
        found += fold.handleExpiredTimer(None, Times(closed), None)
    seen, expected = {}, []
    for at, event, answer, ttl, iso, domain in rows:
        s = seen.setdefault(domain, [set(), 0, at])
        s[0].add(answer)
        s[1] += 1
        if len(s[0]) >= 5 and s[1] >= 8:
            expected.append((domain, event, answer, at, iso, s[2], s[1], len(s[0]), 5))
    assert results(found) == sorted(expected) and len(expected) > 10_000
    assert sum(s.calls for s in fold.handle.states.values()) < 500


def test_alarms_of_a_page_ring_once_and_their_keys_are_forgotten():
    fold = opened(families.Tunnel(window_queries=5, min_queries=1, min_share_micros=0, min_avg_chars=0, idle_s=60))
    rows = [(1_000 + n, n, "t", 40, True, True, f"c{n % 300}") for n in range(900)]
    assert list(fold.handleInputRows(None, frames(fold, rows, 500), None)) == []
    found = list(fold.handleExpiredTimer(None, Times(1_950), None))
    assert sum(map(len, found)) == 900
    assert list(fold.handleExpiredTimer(None, Times(5_000), None)) == []
    assert not fold.entries and fold.alarms.get() == ("{}",) and not fold.pieces and not fold.timer.exists()
