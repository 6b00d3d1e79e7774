"""Keyed folds over a stream in the order of event time, each row once, whatever order it arrives in."""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def longs_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ") if c.endswith(" long")]


PIECE = 2_000           # rows of one waiting piece
RUN = 100_000           # rows sorted at a time, which wait as one run of pieces
FAN = 64                # runs merged at a time, each with one piece in memory
CHUNK = 50_000          # rows folded at a time
OPEN = 4_000_000        # characters of pages that are open at a time
PAGES = 32              # entries of a bucket's keys are read and written a page at a time


class OrderedFold(StatefulProcessor):
    """Rows of a key wait until the watermark has passed their second, and are then folded in order.

    ``row``: columns that wait; the first is ``epoch_s`` and the first ``order`` of them give the order. ``out``: columns of a result,
    to which ``shed`` is added. With a ``capacity``, at most so many rows of a key wait at a time: later arrivals are shed and counted
    in a row that has only the key and ``shed``. Without, all wait.

    Many keys share a bucket, which is what Spark groups by: calls and frames are paid for a bucket and batch. Rows wait in sorted runs
    of small pieces. Runs are merged with one piece of each in memory, many runs into longer ones first, so a busy key never lies in memory
    whole. What is kept of a key is its own entry; entries of keys with the same hash share a page, so calls to the store are paid for a page.
    """

    row, out, order = "", "", 2
    #: Columns that make up the key, and their names in a result.
    group: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    def __init__(self, capacity: int | None = None):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "lo long, seq long", "rows string")
        self.counter = handle.getValueState("counter", "n long")
        self.held = handle.getMapState("held", "id string", "n long")
        self.entries = handle.getMapState("entries", "page int", "data string")
        self.alarms = handle.getValueState("earliest", "seconds string")
        self.timer = handle.getValueState("timer", "second long")
        self.id, self.page = "", None
        self.opened: dict[int, tuple[dict, bool, int]] = {}
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further states of a family; their entries are keyed by ``id``."""

    def load(self) -> dict:
        """What the family keeps of the current key, as JSON has it."""
        return (self.kept.get(self.id) or [{}])[0]

    def save(self, state: dict) -> None:
        self.kept[self.id], self.changed = [state, self._alarm()], True

    def forget(self) -> None:
        if (alarm := self._alarm()) is None:
            self.kept.pop(self.id, None)
        else:
            self.kept[self.id] = [{}, alarm]
        self.changed = True

    def _alarm(self) -> int | None:
        return (self.kept.get(self.id) or [None, None])[1]

    def _turn_to(self, page: int) -> None:
        """Make a page the current one; pages stay open, up to a size, until all are closed."""
        if page == self.page:
            return
        self._set_aside()
        if sum(size for *_, size in self.opened.values()) > OPEN:
            self._close_pages()
        if page not in self.opened:
            held = self.entries.getValue((page,))
            self.opened[page] = (json.loads(held[0]) if held else {}, False, len(held[0]) if held else 0)
        self.page, (self.kept, self.changed, _) = page, self.opened[page]

    def _set_aside(self) -> None:
        if self.page is not None:
            self.opened[self.page] = (self.kept, self.changed, self.opened[self.page][2])
            if self.changed and (earliest := self._earliest()) is not None:
                self.rings[str(self.page)] = earliest
            elif self.changed:
                self.rings.pop(str(self.page), None)
            self.page = None

    def _close_pages(self) -> None:
        """Write the open pages that have changed back."""
        self._set_aside()
        for page, (kept, changed, _) in self.opened.items():
            if changed and kept:
                self.entries.updateValue((page,), (json.dumps(kept),))
            elif changed:
                self.entries.removeKey((page,))
        self.opened.clear()

    def _earliest(self) -> int | None:
        return min((alarm for _, alarm in self.kept.values() if alarm is not None), default=None)

    def reduced(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of a batch, in order; a family may leave out those that cannot matter."""
        return rows

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def idle(self, key: tuple, closed: int) -> list[tuple]:
        """Called once the second asked for has passed: nothing of the key before second ``closed`` can come any more."""
        return []

    def wake(self, second: int) -> None:
        """Call ``idle`` for the current key once the watermark has passed ``second``."""
        self.kept[self.id], self.changed = [self.load(), second], True

    def _set_timer(self, second: int | None) -> None:
        registered = self.timer.get()[0] if self.timer.exists() else None
        if second is not None and (registered is None or second < registered):
            self.timer.update((second,))
            self.handle.registerTimer((second + 1) * 1000)

    def _keep(self, rows: Iterable[tuple]) -> None:
        """Store ordered rows as the pieces of a new run."""
        run, rows = (self.counter.get()[0] if self.counter.exists() else 0) + 1, iter(rows)
        for n in itertools.count():
            piece = list(itertools.islice(rows, PIECE))
            if not piece:
                break
            self.pieces.updateValue((piece[0][0], run << 32 | n), (json.dumps(piece),))
        self.counter.update((run,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, longs = names_of(self.row), longs_of(self.row)
        shed: dict[tuple, int] = {}
        waiting: list[tuple] = []
        earliest, sorted_parts = None, 0
        while (pdf := next(rows, None)) is not None or waiting:
            if pdf is not None:
                part = self.reduced(pdf.sort_values(names[: self.order]))
                new = list(zip(*(_plain(part[c], c in longs) for c in [*names, *self.group])))
                waiting += self._admitted(new, shed) if self.capacity is not None else new
                sorted_parts += 1
                if len(waiting) < RUN:
                    continue
            if sorted_parts > 1:
                waiting.sort(key=self._place)
            earliest = waiting[0][0] if earliest is None else min(earliest, waiting[0][0])
            self._keep(waiting)
            waiting, sorted_parts = [], 0
        self._set_timer(earliest)
        yield from self._frames([], list(shed.items()))

    def _place(self, row: tuple) -> tuple:
        """Order of a row, nulls last."""
        return tuple((v is None, v) for v in row[: self.order])

    def _admitted(self, rows: list[tuple], shed: dict[tuple, int]) -> list[tuple]:
        held, admitted = {}, []
        for r in rows:
            key = r[len(r) - len(self.group):]
            if key not in held:
                known = self.held.getValue((json.dumps(key),))
                held[key] = known[0] if known else 0
            if held[key] < self.capacity:
                held[key] += 1
                admitted.append(r)
            else:
                shed[key] = shed.get(key, 0) + 1
        for key, n in held.items():
            self.held.updateValue((json.dumps(key),), (n,))
        return admitted

    def _due(self, closed: int) -> Iterator[tuple]:
        """Waiting rows before second ``closed`` in order; the rest of a piece is kept."""
        while True:
            places = sorted(tuple(k) for k in self.pieces.keys() if k[0] < closed)
            runs = sorted({seq >> 32 for _, seq in places})
            if len(runs) <= FAN:
                yield from self._merged(places, closed)
                return
            for n in range(0, len(runs), FAN):
                among = set(runs[n: n + FAN])
                if len(among) > 1:
                    self._keep(self._merged([p for p in places if p[1] >> 32 in among], closed))

    def _merged(self, coming: list[tuple], closed: int) -> Iterator[tuple]:
        """Rows before second ``closed`` of the ordered pieces, each loaded when its turn comes."""
        at, heap, rest = 0, [], []
        while at < len(coming) or heap:
            while at < len(coming) and (not heap or coming[at][0] <= heap[0][0][0][1]):
                place, at = coming[at], at + 1
                piece = json.loads(self.pieces.getValue(place)[0])
                self.pieces.removeKey(place)
                cut = next((n for n, r in enumerate(piece) if r[0] >= closed), len(piece))
                rest += piece[cut:]
                heapq.heappush(heap, (self._place(piece[0]), place, 0, piece[:cut]))
            _, place, n, piece = heap[0]
            yield tuple(piece[n])
            if n + 1 < len(piece):
                heapq.heapreplace(heap, (self._place(piece[n + 1]), place, n + 1, piece))
            else:
                heapq.heappop(heap)
        if rest:
            rest.sort(key=self._place)
            self._keep(rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        if not self.timer.exists() or self.timer.get()[0] >= closed:
            return                                   # done by an earlier timer of this batch
        width = len(names_of(self.row))
        alarms = self.alarms.get()[0] if self.alarms.exists() else "{}"
        self.rings: dict[str, int] = json.loads(alarms)
        due = self._due(closed)
        while rows := list(itertools.islice(due, CHUNK)):
            by_key: dict[tuple, list[tuple]] = {}
            for r in rows:
                by_key.setdefault(r[width:], []).append(r[:width])
            found: list[tuple] = []
            for page, name, of in sorted((_page(name), name, of) for of in by_key for name in [json.dumps(of)]):
                self._turn_to(page)
                self.id, its = name, by_key[of]
                found += self.fold(of, its)
                if self.capacity is not None:
                    self.held.updateValue((self.id,), (self.held.getValue((self.id,))[0] - len(its),))
            yield from self._frames(found)
        self._set_aside()
        for page in sorted(int(page) for page, second in self.rings.items() if second < closed):
            self._turn_to(page)
            found = []
            for name in [name for name, (_, alarm) in self.kept.items() if alarm is not None and alarm < closed]:
                self.id = name
                self.kept[name], self.changed = [self.load(), None], True
                found += self.idle(tuple(json.loads(name)), closed)
                if self.kept.get(name) == [{}, None]:
                    del self.kept[name]
            yield from self._frames(found)
        self._close_pages()
        if (kept := json.dumps(self.rings)) != alarms:
            self.alarms.update((kept,))
        seconds = [k[0] for k in self.pieces.keys()] + [*self.rings.values()]
        self.timer.clear()
        self._set_timer(min(seconds, default=None))

    def _frames(self, rows: list[tuple], shed: list[tuple] = []) -> Iterator[pd.DataFrame]:
        names = names_of(self.out)
        if not rows and not shed:
            return
        refused = [tuple(dict(zip(self.keys, key)).get(c) for c in names) + (n,) for key, n in shed]
        columns = zip([*names, "shed"], zip(*[r + (None,) for r in rows], *refused))
        wholes = {*longs_of(self.out), "shed"}
        frame = pd.DataFrame({c: _whole(values) if c in wholes else np.fromiter(values, object, len(values)) for c, values in columns})
        yield frame

    def close(self) -> None:
        pass


class Members:
    """A set kept per key: in the key's own entry while it is small, then as entries of a map state."""

    LIMIT = 256

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.more = handle.getMapState(name, "id string, member string", "seen boolean")

    def add(self, fold: OrderedFold, state: dict, known: set, member: str) -> bool:
        """Whether ``member`` is new. ``known`` saves looking up members met before in the same call."""
        if not known:
            known.update(state.setdefault("members", []))
        if member in known:
            return False
        known.add(member)
        if len(state["members"]) < self.LIMIT:
            state["members"].append(member)
        elif self.more.containsKey((fold.id, member)):
            return False
        else:
            self.more.updateValue((fold.id, member), (True,))
            state["more"] = True
        return True

    def clear(self, fold: OrderedFold, state: dict) -> None:
        if state.get("more"):
            for entry in [k for k in self.more.keys() if k[0] == fold.id]:
                self.more.removeKey(entry)


def _page(name: str) -> int:
    return zlib.crc32(name.encode()) % PAGES


def _plain(column: pd.Series, whole: bool) -> list:
    """Python values, nulls as None; whole numbers stay whole beside nulls."""
    if not column.hasnans:
        if not whole or column.dtype.kind == "i":
            return column.tolist()
    if whole:
        column = column.astype("Int64")
    return column.astype(object).where(column.notna(), None).tolist()


def _whole(values: tuple):
    """Whole numbers, beside nulls too."""
    return pd.array(values, dtype="Int64") if None in values else np.array(values, dtype=np.int64)


def run_fold(stream: DataFrame, fold: OrderedFold, lateness: str, buckets: int = 1024) -> DataFrame:
    """``fold`` over ``stream``, which has the key and row columns; rows later than ``lateness`` are dropped by the watermark."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("epoch_s")).withWatermark("event_time", lateness)
    by = timed.select(F.pmod(F.xxhash64(*fold.group), F.lit(buckets)).alias("bucket"), *fold.group, *[c for c in names_of(fold.row) if c not in fold.group], "event_time")
    return by.groupBy("bucket").transformWithStateInPandas(fold, f"{fold.out}, shed long", "append", "eventTime")
