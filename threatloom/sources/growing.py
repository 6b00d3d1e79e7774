"""A log that another program still writes to, as a streaming source: whole lines only, each once, across rotation and truncation."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threatloom.session import ship_package

#: Bytes of a task, and read at once while looking for the last line end.
RANGE_BYTES, LOOK_BYTES = 32 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of the file with this inode; ``first``: a line begins at start."""

    path: str
    inode: int
    start: int
    end: int
    first: bool


def whole_lines(path: str, start: int, size: int) -> int:
    """Where the last complete line of path[start:size] ends; ``start`` if there is none."""
    with open(path, "rb") as log:
        end = size
        while end > start:
            begin = max(start, end - LOOK_BYTES)
            log.seek(begin)
            at = log.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def by_inode(path: str, inode: int) -> str | None:
    """The file with this inode: the log itself or one it was renamed to beside it."""
    here = Path(path)
    for candidate in (here, *sorted(here.parent.glob(f"{here.name}*"))):
        try:
            if candidate.stat().st_ino == inode:
                return str(candidate)
        except OSError:
            continue
    return None


def lines_of(part: Range) -> Iterator[tuple[str, int, int]]:
    """(line, inode, offset) of a range; text that is not UTF-8 keeps its place with replacement characters."""
    path = by_inode(part.path, part.inode)
    if path is None:
        raise FileNotFoundError(f"{part.path}: inode {part.inode} is gone before its lines were read")
    with open(path, "rb") as log:
        log.seek(part.start - (not part.first))
        if not part.first:
            log.readline()
        while (at := log.tell()) < part.end:
            line = log.readline()
            if not line.endswith(b"\n"):
                break
            yield line[:-1].decode("utf-8", "replace"), part.inode, at


class GrowingReader(DataSourceStreamReader):
    """Offsets are an inode and the end of its last whole line; a rotation also carries the rest of the file before.

    ``max_bytes`` bounds what one micro-batch takes once the reader knows where it stands (a restart takes up to the end).
    """

    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = {"inode": -1, "end": 0}
        return dict(self.at)

    def latestOffset(self) -> dict:
        at = self.at or {"inode": -1, "end": 0}
        try:
            stat = os.stat(self.path)
        except OSError:
            return _place(at)                         # not there yet, or between two files
        same = stat.st_ino == at["inode"]
        start = at["end"] if same and stat.st_size >= at["end"] else 0
        limit = stat.st_size
        if self.at is not None and limit - start > self.max_bytes:
            limit = max(start + self.max_bytes, _first_line_end(self.path, start))
        found = {"inode": stat.st_ino, "end": whole_lines(self.path, start, limit)}
        if not same and at["inode"] >= 0 and (rest := self._rest(at)) is not None:
            found["rest"] = rest
        elif same and start == 0 and at["end"] > 0:
            found["cut"] = at.get("cut", 0) + 1      # truncated: even the same end is new data then
        elif same and "cut" in at:
            found["cut"] = at["cut"]
        return found

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = end
        ranges: list[InputPartition] = []
        same = start["inode"] == end["inode"] and end.get("cut", start.get("cut", 0)) == start.get("cut", 0)
        if start["inode"] not in (-1, end["inode"]) and (rest := end.get("rest", self._rest(start))) is not None:
            ranges += self._ranges(start["inode"], start["end"], rest)
        if end["inode"] >= 0:
            begin = start["end"] if same and end["end"] >= start["end"] else 0
            ranges += self._ranges(end["inode"], begin, end["end"])
        return ranges or [Range(self.path, end["inode"], 0, 0, True)]

    def _rest(self, at: dict) -> int | None:
        """Where the last whole line of a rotated file ends, if it is still there."""
        old = by_inode(self.path, at["inode"])
        return whole_lines(old, at["end"], os.stat(old).st_size) if old else None

    def _ranges(self, inode: int, start: int, end: int) -> list[Range]:
        return [Range(self.path, inode, at, min(at + RANGE_BYTES, end), at == start) for at in range(start, end, RANGE_BYTES)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, int]]:
        return lines_of(partition) if partition.end > partition.start else iter(())


def _place(at: dict) -> dict:
    return {k: at[k] for k in ("inode", "end", "cut") if k in at}


def _first_line_end(path: str, start: int) -> int:
    with open(path, "rb") as log:
        log.seek(start)
        log.readline()
        return log.tell()


class GrowingLog(DataSource):
    """Format ``growing_log``: rows (line, inode, offset) of the file at ``path``, which every executor must be able to read."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "line string, inode long, offset long"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("maxBytesPerTrigger", 1 << 30)))


def growing_log(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Lines of a growing log as a stream. A torn last line waits until it is complete.

    After a rotation the rest of the renamed file is read first, if it is still beside the new one, then the new one from its start; a
    file that got shorter is read from its start again. The place is kept in the query's checkpoint.
    """
    ship_package(spark)
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", path).option("maxBytesPerTrigger", max_bytes).load()
