"""WARC archives as a chunked record table: record number, chunk number, bytes and the payload digest so far."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threatloom.llm.common import map_arrow, written

#: Bytes of one chunk, and of one batch of chunks that leaves a task.
CHUNK, BATCH = 1 << 16, 1 << 22
#: Payloads of fewer bytes are never replaced by revisits.
LEAST_REVISIT = 0
DATE = "2000-01-01T00:00:00Z"
#: Bytes of a header that may go before the first payload chunk whatever the chunk size.
HEADER = 1024
CHUNKS = "record long, chunk long, data binary, digest binary, last boolean"
RECORDS = "record long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def _safe_uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"


def record_head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """The record's header and, for a response, the HTTP header before the payload."""
    http = b"" if refers_to is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
              f"WARC-Target-URI: {_safe_uri(url, page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): of pages with one payload, all but the smallest page_id refer to it.

    Payloads meet by SHA-1 and length; groups are counted before the join, and only groups of two or more take part in it.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    typed = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = typed.groupBy("sha1", "bytes").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= least))
    joined = typed.join(groups.drop("n"), ["sha1", "bytes"], "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def record_chunks(pages: DataFrame, date: str = DATE, chunk: int = CHUNK, least: int = LEAST_REVISIT) -> DataFrame:
    """Chunk rows of one record per row of ``pages``; the chunks of a record in order are its bytes, records are whole archives in any order.

    The payload is read in place from the incoming buffer, ``chunk`` bytes at a time; batches of chunks leave as they fill. ``digest`` is the
    SHA-1 of the payload up to the end of the chunk, so a reader can tell which chunk is damaged; ``last`` marks the record's final chunk.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, out = TaskContext.get().partitionId() << 33, 0, ([], [], [], [], [])

        def flush():
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f.split()[0] for f in CHUNKS.split(", ")])

        for batch in batches:
            ids, urls, sums, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            payloads = batch.column(2)
            for k in range(batch.num_rows):
                payload = memoryview(payloads[k].as_buffer() or b"")
                head = record_head(ids[k], urls[k], len(payload), base64.b32encode(bytes.fromhex(sums[k])).decode(), refers[k], date)
                if refers[k] is not None:
                    payload = payload[:0]
                running, place = hashlib.sha1(), 0
                while len(head) > max(chunk, HEADER):          # a very long URL takes chunks of its own
                    for column, value in zip(out, (number, place, head[:chunk], running.digest(), False)):
                        column.append(value)
                    head, place, size = head[chunk:], place + 1, size + chunk
                    if size >= BATCH:
                        yield flush()
                        size, out = 0, ([], [], [], [], [])
                for start in range(0, max(1, len(payload)), chunk):
                    part = payload[start: start + chunk]
                    running.update(part)
                    last = start + chunk >= len(payload)
                    data = (head if not start else b"") + bytes(part) + (b"\r\n\r\n" if last else b"")
                    for column, value in zip(out, (number, place, data, running.digest(), last)):
                        column.append(value)
                    place, size = place + 1, size + len(data)
                    if size >= BATCH:
                        yield flush()
                        size, out = 0, ([], [], [], [], [])
                number += 1
        if out[0]:
            yield flush()

    return map_arrow(with_revisits(pages, least), rows, CHUNKS)


@dataclass
class _Reader:
    """Parses one record from its bytes, piece by piece; keeps the header and a running digest, never the payload."""

    record: int
    head: bytearray = field(default_factory=bytearray)
    fields: dict[str, str] | None = None
    http_done: bool = False
    left: int = 0
    size: int = 0
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha1)
    tail: bytearray = field(default_factory=bytearray)
    intact: bool = True

    def feed(self, data: memoryview, digest: bytes) -> None:
        while len(data):
            if self.fields is None:
                data = self._head_line(data)
                if self.fields is None and self._ended():
                    self.fields = self._parse(bytes(self.head))
                    self.left = int(self.fields.get("content-length", 0))
                    self.head = bytearray()
                    self.http_done = self.fields.get("warc-type") != "response"
            elif not self.http_done and self.left:
                before = len(self.head)
                data = self._head_line(data)
                self.left -= len(self.head) - before
                if self._ended():
                    self.http_done = True
            elif self.left:
                part = data[: self.left]
                self.digest.update(part)
                self.size += len(part)
                self.left -= len(part)
                data = data[len(part):]
            else:
                self.tail += data[:8]
                data = data[len(data):]
        if self.digest.digest() != digest:
            self.intact = False

    def _head_line(self, data: memoryview) -> memoryview:
        """Take bytes up to the next line end. A header may be as long as its URL; one that never ends leaves the record not intact."""
        end = bytes(data).find(b"\n")
        cut = len(data) if end < 0 else end + 1
        self.head += data[:cut]
        return data[cut:]

    def _ended(self) -> bool:
        return self.head.endswith(b"\r\n\r\n")

    @staticmethod
    def _parse(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not re.match(r"WARC/1\.[01]$", lines[0]):
            raise ValueError(f"not a record: {lines[0]!r}")
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}

    def row(self) -> tuple:
        get = (self.fields or {}).get
        number = lambda name: int(get(name)) if get(name) is not None else None
        claimed = (get("warc-payload-digest") or "").removeprefix("sha1:")
        if get("warc-type") == "response":
            size, digest = self.size, base64.b32encode(self.digest.digest()).decode()
        else:
            size, digest = number("x-payload-length"), claimed
        intact = self.intact and self.left == 0 and bytes(self.tail) == b"\r\n\r\n" and digest == claimed and size == number("x-payload-length")
        return self.record, number("x-page-id"), get("warc-target-uri"), size, digest, get("warc-type"), number("x-refers-to-page"), intact


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table; ``intact`` if every digest, length and end agrees.

    A record of one chunk is read where it lies. The chunks of a longer one meet in one task in order and stream through a parser that holds
    no more than a header.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []

        def flush():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in RECORDS.split(", ")])

        for batch in batches:
            records, digests, data = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2)
            for k, record in enumerate(records):
                if reader is None or reader.record != record:
                    if reader:
                        out.append(reader.row())
                    reader = _Reader(record)
                reader.feed(memoryview(data[k].as_buffer()), digests[k])
            if len(out) >= 10_000:
                yield flush()
                out = []
        if reader:
            out.append(reader.row())
        if out:
            yield flush()

    alone = F.coalesce(F.col("last") & (F.col("chunk") == 0), F.lit(False))
    parts = chunks.where(~alone).repartition("record").sortWithinPartitions("record", "chunk")
    return map_arrow(chunks.where(alone), rows, RECORDS).unionByName(map_arrow(parts, rows, RECORDS))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder as a chunk table and read them back: one row per row of ``pages``.

    A null html is an empty payload, a null url names the page, a null page_id comes back null and refers to a page that has an id if
    there is one. Empty payloads revisit each other as any others do. Rows that repeat a page_id and payload are all responses.
    An empty table gives none. Extra columns are ignored.
    """
    return read_records(written(record_chunks(pages, **options), "warc"))
