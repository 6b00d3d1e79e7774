"""Fill-in-middle transformation by rotating blocks of a text in place, and its exact inverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatloom.llm.common import map_arrow, text_bytes

#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents, so many are transformed, and so many of those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes whose characters are counted at once.
BLOCK = 1 << 16


def _turn(buffer: bytearray, start: int, end: int) -> None:
    """Reverse buffer[start:end] in place, a block from each end at a time."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        head = buffer[start: start + n]
        buffer[start: start + n] = buffer[end - n: end][::-1]
        buffer[end - n: end] = head[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange buffer[start:cut] and buffer[cut:end] by three reversals."""
    _turn(buffer, start, cut)
    _turn(buffer, cut, end)
    _turn(buffer, start, end)


def code_points(text: bytes | bytearray) -> int:
    """Bytes that do not continue a character."""
    view = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero((view[at: at + BLOCK] & 0xC0) != 0x80)) for at in range(0, len(view), BLOCK))


def byte_cuts(text: bytes | bytearray, units: tuple[int, int]) -> tuple[int, int]:
    """Where the code points of the two given numbers (ascending) begin, in one scan by blocks."""
    view, found, seen = np.frombuffer(text, np.uint8), [], 0
    for at in range(0, len(view), BLOCK):
        starts = np.flatnonzero((view[at: at + BLOCK] & 0xC0) != 0x80)
        while len(found) < 2 and units[len(found)] < seen + len(starts):
            found.append(at + int(starts[units[len(found)] - seen]))
        seen += len(starts)
    return tuple(found + [len(view)] * (2 - len(found)))


def draws(doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document; a null id draws like an empty one."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[k: k + 8], 16) for k in range(0, 32, 8)]


def transform(text: bytes, doc_id: int | None) -> tuple[bytearray, int, str, int | None, int | None]:
    """(output, code points, form, code points of prefix and of middle)."""
    buffer, n = bytearray(text), code_points(text)
    h = draws(doc_id)
    if not text or h[2] % 100 >= RATE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return buffer, n, "plain", None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    one, two = byte_cuts(text, (first, second))
    # Later sentinels first, so that the cuts before them stay valid: <P>prefix<M>middle<S>suffix.
    buffer[two:two] = SUFFIX
    buffer[one:one] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = len(PREFIX) + one, len(PREFIX) + two + len(MIDDLE)
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer, n, form, first, second - first


def restore(output: bytes, form: str) -> bytearray:
    """The text behind ``output``: the rotation is turned back and the sentinels go, last one first.

    A transformed text holds each sentinel once: the text had none, and no end of one begins another.
    """
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form == "psm":
        start, cut = buffer.index(SUFFIX), buffer.index(MIDDLE)
    else:
        start, cut = 0, buffer.index(PREFIX)
    rotate(buffer, start, cut, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at: at + len(mark)]
    return buffer


def infilled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    Cuts and form are drawn from the doc_id, so a lost task draws them again alike; repeated rows give repeated results. A null text
    is empty and an empty one stays plain, as does one that holds a sentinel (prefix_chars and middle_chars are null then).
    A null doc_id draws like an empty one. Other columns are not read. A task holds one Arrow batch and one text's buffer.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc_id, *transform(text or b"", doc_id)) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            ids, outputs, sizes, forms, prefixes, middles = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(map(bytes, outputs), pa.binary())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    frame = docs.select("doc_id", text_bytes())
    kind = frame.schema["doc_id"].dataType.simpleString()
    found = map_arrow(frame, rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", found["output"].cast("string"))


def restored(found: DataFrame) -> DataFrame:
    """``found`` of ``infilled`` with the column ``text``, rebuilt from output and form alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(batch.schema.get_field_index("output")), batch.column(batch.schema.get_field_index("form"))
            texts = pa.array((bytes(restore(o or b"", f or "plain")) for o, f in zip(outputs.to_pylist(), forms.to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    columns = [c for c in found.columns if c != "text"]
    frame = found.select(*(text_bytes(c) if c == "output" else c for c in columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    back = map_arrow(frame, rows, f"{schema}, text binary")
    return back.withColumns({"output": back["output"].cast("string"), "text": back["text"].cast("string")})
