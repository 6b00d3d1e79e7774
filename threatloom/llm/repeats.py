"""Repeated passages: maximal repeats from the common-prefix interval tree of enhanced suffix arrays.

Equal windows of ``least`` bytes choose the same gram (the one with the least hash among their own), so windows are dealt out by that
gram. Neighbouring windows of one gram travel together as a *stretch* of text. Each slot of stretches gets a suffix array.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threatloom.llm.common import map_arrow, shared_folder, text_bytes, written
from threatloom.session import cut_lineage, ship_package

LEAST = 50
#: Text of a chunk (whole texts), of the grams of a bucket, and of the stretches of a slot, in bytes of input.
CHUNK_BYTES, BUCKET_BYTES, SLOT_BYTES = 12 << 20, 8 << 20, 2 << 20
#: Text hashed at once, windows of a stretch, and suffixes sorted at once.
BLOCK, STRETCH, SUFFIXES = 1 << 20, 32, 200_000
#: Grams with more different stretches than this are dealt out by whole windows.
HOT = 4096

_SYMBOLS = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a gram's hash kept beside its bucket, and bits for the number of its stretches in a chunk (as a power of two).
_KEPT, _SIZE = 36, 4
_BYTES = (_KEPT + _SIZE) // 8


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x * _ONE) ^ (y * _TWO + np.uint64(1))
    h ^= h >> np.uint64(29)
    h *= _ONE
    return h ^ (h >> np.uint64(32))


def _grams(view: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place."""
    h, n = _SYMBOLS[view], 1
    while n < width:
        step = min(n, width - n)
        h = _mixed(h[: len(h) - step], h[step:])
        n += step
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place."""
    n = 1
    while n < width:
        step = min(n, width - n)
        h = np.minimum(h[: len(h) - step], h[step:])
        n += step
    return h


class Stretches:
    """Stretches of a block of texts: key, twin (hash of all their bytes), number of the text, start in the block, windows."""

    def __init__(self, texts: list[bytes], least: int):
        self.least, self.gram = least, least // 2
        self.text = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(np.r_[0, sizes])[:-1]
        view = np.frombuffer(self.text, np.uint8)
        none = np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        self.key, self.twin, self.owner, self.start, self.windows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none
        if len(view) < least:
            return
        self.grams = _grams(view, self.gram)
        least_gram = _least(self.grams, least - self.gram + 1)
        counts = np.maximum(sizes - least + 1, 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(np.r_[0, counts])[:-1], counts) + self.base[owner]
        key = least_gram[place]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)])
        length = np.diff(np.r_[first, len(key)])
        # Long stretches (of repeated patterns) are cut.
        parts = -(-length // STRETCH)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(np.r_[0, parts])[:-1], parts)
        first, length = np.repeat(first, parts) + nth * STRETCH, np.minimum(np.repeat(length, parts) - nth * STRETCH, STRETCH)
        self.key, self.owner, self.start, self.windows = key[first], owner[first], place[first], length
        self.twin = self.twins(self.start, length)

    def twins(self, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        k, end = self.gram, start + windows + self.least - 1
        return _mixed(_mixed(self.grams[start], self.grams[start + k]), _mixed(self.grams[end - 2 * k], self.grams[end - k]))


def blocks(texts: list[bytes], least: int) -> Iterator[tuple[int, Stretches]]:
    """Number of the first text and stretches of each block of whole texts."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK or at + 1 == len(texts):
            yield first, Stretches(texts[first: at + 1], least)
            first, size = at + 1, 0


def _code(key: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a key: bucket, then the bits kept."""
    return key >> np.uint64(64 - bits - _KEPT)


# --- chunks: whole texts, numbered, written once, bucketed by chunk

def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, nth, doc_id, size, digest, text) as a table bucketed by chunk, so that later steps meet the texts without shuffling them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, nth, held = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            chunks, numbers = [], []
            for size in sizes:
                if held >= CHUNK_BYTES:
                    chunk, nth, held = chunk + 1, 0, 0
                chunks.append(chunk)
                numbers.append(nth)
                nth, held = nth + 1, held + size
            digests = pa.array((hashlib.sha256(text.as_py() or b"").digest() for text in batch.column(1)), pa.binary())
            columns = [pa.array(chunks, pa.int64()), pa.array(numbers, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), digests, batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "nth", "doc_id", "size", "digest", "text"])

    frame = docs.select("doc_id", text_bytes())
    name = f"repeats_{uuid.uuid4().hex}"
    numbered = map_arrow(frame, rows, f"chunk long, nth long, doc_id {frame.schema['doc_id'].dataType.simpleString()}, size long, digest binary, text binary")
    parts = max(1, frame.rdd.getNumPartitions())
    numbered.write.format("parquet").option("compression", "zstd").option("path", shared_folder(docs.sparkSession, "repeats")).bucketBy(parts, "chunk").saveAsTable(name)
    chunks = docs.sparkSession.table(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return chunks


def _copies(chunks: DataFrame) -> DataFrame:
    """(chunk, nth, size) of the texts that a smaller document holds too, as a whole (by SHA-256). The rest of the work leaves them out."""
    least = chunks.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("least"))
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return chunks.select("chunk", "nth", "doc_id", "size", "digest").join(least, F.col("digest") == F.col("same")).where(later).select("chunk", "nth", "size")


def _without(left: pa.Table, nths: pa.ChunkedArray) -> pa.Table:
    """The texts of a chunk that are no copies."""
    return left.filter(pc.invert(pc.is_in(left.column("nth"), pc.drop_null(nths)))) if len(nths) else left


# --- grams that several stretches share

def _shared_grams(chunks: DataFrame, copies: DataFrame, bits: int, least: int) -> DataFrame:
    """(chunk, hot, codes): the grams of a chunk that other chunks have too, or that begin several different stretches in it."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["bucket", "chunk", "grams"], [pa.int64(), pa.int64(), pa.binary()]
        left = _without(left, right.column("nth"))
        found = [(s.key, s.twin) for _, s in blocks([t or b"" for t in left.column("text").to_pylist()], least)]
        key, twin = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        if not len(key):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        code = _code(key, bits)
        order = np.argsort(code)
        code = code[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        kinds = np.diff(np.r_[starts, len(code)])
        again = np.repeat(kinds > 1, kinds)
        own, mine = code[again], twin[order[again]]
        inner = np.lexsort((mine, own))
        own, mine = own[inner], mine[inner]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (mine[1:] != mine[:-1])][: len(own)]
        kinds[kinds > 1] = np.unique(own[fresh], return_counts=True)[1]
        code = code[starts]
        power = np.minimum(np.ceil(np.log2(kinds)), (1 << _SIZE) - 1).astype(np.uint64)
        bucket = (code >> np.uint64(_KEPT)).astype(np.int64)
        packed = ((code & np.uint64((1 << _KEPT) - 1)) << np.uint64(_SIZE) | power).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].copy()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [packed[s:e].tobytes() for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])]
        return pa.Table.from_arrays([pa.array(bucket[starts]), pa.array([left.column("chunk")[0].as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groupby(_rows(batches), lambda r: r[0]):
            chunks, blobs = zip(*((chunk, grams) for _, chunk, grams in rows))
            sizes = np.array([len(b) // _BYTES for b in blobs])
            raw = np.zeros((int(sizes.sum()), 8), np.uint8)
            raw[:, :_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _BYTES)
            packed = raw.view("<u8").ravel()
            owner = np.repeat(np.arange(len(blobs)), sizes)
            gram, kinds = packed >> np.uint64(_SIZE), np.left_shift(1, (packed & np.uint64((1 << _SIZE) - 1)).astype(np.int64))
            order = np.argsort(gram)
            ranked = gram[order]
            starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            count = np.diff(np.r_[starts, len(gram)])
            total = np.add.reduceat(kinds[order], starts)
            state = np.empty(len(gram), np.int8)
            state[order] = np.repeat(np.where(total > HOT, 2, np.where(total > 1, 1, 0)), count)
            full = gram | np.uint64(bucket << _KEPT)
            out = []
            for at, (s, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())):
                for hot in (1, 2):
                    if len(found := full[s: s + n][state[s: s + n] == hot]):
                        out.append((chunks[at], hot == 2, found.astype("<u8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chunk", "hot", "codes"])

    ship_package(chunks.sparkSession)
    asked = chunks.select("chunk", "nth", "text").groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(ask, "bucket long, chunk long, grams binary")
    return map_arrow(asked.repartition("bucket").sortWithinPartitions("bucket"), answer, "chunk long, hot boolean, codes binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


# --- stretches that are sent, and those that the chunk settles by itself

def _ranks(ids: pa.Array) -> np.ndarray:
    """Order of document ids, equal ids alike, null last."""
    plain = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pc.rank(plain, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of bytes, zero behind the end."""
    at = np.arange(int(size.max(initial=0)))
    return np.where(at < size[:, None], text[np.minimum(start[:, None] + at, len(text) - 1)], 0)


def _settle(key: np.ndarray, twin: np.ndarray, rank: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each stretch the stretch of the least rank with the same bytes, or itself if that has its rank."""
    both = _mixed(key, twin + size.astype(np.uint64))
    order = np.argsort(both)
    ranked = both[order]
    same = ranked[1:] == ranked[:-1]
    order = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    order = order[np.lexsort((rank[order], both[order]))]
    new = np.r_[True, both[order][1:] != both[order][:-1]][: len(order)]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    chief = np.arange(len(key))
    later = rank[order] > rank[lead]
    own, lead = order[later], lead[later]
    for at in range(0, len(own), 1 << 14):
        x, y = own[at: at + (1 << 14)], lead[at: at + (1 << 14)]
        same = (size[x] == size[y]) & (_pieces(text, start[x], size[x]) == _pieces(text, start[y], size[x])).all(axis=1)
        chief[x[same]] = y[same]
    return chief


def _unions(owner: np.ndarray, start: np.ndarray, size: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and size of the unions of spans of each owner; ``base`` sets the owners' texts one behind the other."""
    begin, end = merged(start + base[owner] + owner, size)      # one place between two texts, so that spans of two never touch
    own = np.searchsorted(base + np.arange(len(base)), begin, "right") - 1
    return own, begin - base[own] - own, end - begin


def _sent(chunks: DataFrame, copies: DataFrame, shared: DataFrame, bits: int, slots: int, least: int, merge: bool) -> DataFrame:
    """(slot, key, chunk, nth, owner, start, size, body, chief_nth, chief_start).

    With a body: a stretch to compare with those of other chunks. Without: its bytes are those of a stretch of a smaller document of
    the chunk, the chief, so it is a repeat whatever others hold. A gram that many documents share is thus sent once a chunk.
    With ``merge``, overlapping stretches of the latter kind become one row, without a chief. ``key`` tells grams of a slot apart, as
    far as 16 bits do.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"slot long, key long, chunk long, nth long, owner {kind}, start long, size long, body binary, chief_nth long, chief_start long"

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in schema.split(", ")]
        left = _without(left, right.column("nth"))
        owners = left.column("doc_id").combine_chunks()
        types = [pa.int64()] * 4 + [owners.type] + [pa.int64()] * 2 + [pa.binary()] + [pa.int64()] * 2
        empty = pa.Table.from_arrays([pa.array([], t) for t in types], names)
        if not left.num_rows:
            return empty
        chunk = left.column("chunk")[0].as_py()
        texts = [t or b"" for t in left.column("text").to_pylist()]
        numbers, rank = left.column("nth").to_numpy(), _ranks(owners)
        told = [(h, np.frombuffer(c, "<u8")) for c, h in zip(right.column("codes").to_pylist(), right.column("hot").to_pylist()) if c is not None]
        codes = {hot: np.sort(np.concatenate([np.zeros(0, "<u8"), *(c for h, c in told if h == hot)])) for hot in (False, True)}

        def among(code: np.ndarray, hot: bool) -> np.ndarray:
            have = codes[hot]
            return have[np.minimum(np.searchsorted(have, code), len(have) - 1)] == code if len(have) else np.zeros(len(code), bool)

        base, found = np.cumsum([0, *map(len, texts)]), []
        for first, s in blocks(texts, least):
            hot = among(_code(s.key, bits), True)
            cold = ~hot
            found.append((s.key[cold], s.twin[cold], s.owner[cold] + first, s.start[cold] + base[first], s.windows[cold], np.zeros(int(cold.sum()), bool)))
            if hot.any():
                n = s.windows[hot]
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start, owner = np.repeat(s.start[hot], n) + nth, np.repeat(s.owner[hot], n)
                twin = s.twins(start, np.ones(len(start), np.int64))
                found.append((twin, twin, owner + first, start + base[first], np.ones(len(start), np.int64), np.ones(len(start), bool)))
        key, twin, owner, start, windows, whole = (np.concatenate(x) for x in zip(*found))
        if not len(key):
            return empty
        text, size = np.frombuffer(b"".join(texts), np.uint8), windows + least - 1
        chief = _settle(key, twin, rank[owner], start, size, text)
        own = chief == np.arange(len(key))
        send, known, inside = np.flatnonzero(own & (whole | among(_code(key, bits), False))), np.flatnonzero(~own), start - base[owner]
        if merge:
            known_owner, known_start, known_size = _unions(owner[known], inside[known], size[known], base)
        else:
            known_owner, known_start, known_size = owner[known], inside[known], size[known]
        raw, n = memoryview(text), len(known_owner)
        bodies = [bytes(raw[s:e]) for s, e in zip(start[send].tolist(), (start + size)[send].tolist())] + [None] * n
        slot = np.r_[(key[send] % np.uint64(slots)).astype(np.int64), (chunk * 31 + np.arange(n)) % slots]
        chief_owner, chief_start = (known_owner, known_start) if merge else (owner[chief[known]], inside[chief[known]])
        sent, settled = np.zeros(len(send), np.int64), np.zeros(n, np.int64)
        absent, both = np.r_[sent == 0, settled > 0] if not merge else np.ones(len(send) + n, bool), np.r_[owner[send], known_owner]
        columns = [pa.array(slot), pa.array(np.r_[((key[send] // np.uint64(slots)) & np.uint64(0xFFFF)).astype(np.int64), settled]), pa.array(np.full(len(both), chunk)),
                   pa.array(numbers[both]), owners.take(pa.array(both)), pa.array(np.r_[inside[send], known_start]),
                   pa.array(np.r_[sent, known_size], mask=np.r_[sent == 0, settled > 0]), pa.array(bodies, pa.binary()),
                   pa.array(numbers[np.r_[owner[send], chief_owner]], mask=absent), pa.array(np.r_[inside[send], chief_start], mask=absent)]
        return pa.Table.from_arrays(columns, names)

    notes = shared.select("chunk", "hot", "codes", F.lit(None).cast("long").alias("nth")).unionByName(
        copies.select("chunk", F.lit(None).cast("boolean").alias("hot"), F.lit(None).cast("binary").alias("codes"), "nth"))
    return chunks.select("chunk", "nth", "doc_id", "text").groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(rows, schema)


# --- enhanced suffix arrays

def suffix_array(bodies: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``least`` bytes in order: body, place in it, common prefix with the next, and the symbol to the left.

    The left symbol of a body's first suffix is like no other.
    """
    sizes = np.array([len(b) for b in bodies])
    counts = np.maximum(sizes - least + 1, 0)
    body = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    width = -(-int(sizes.max(initial=0)) // 8)
    view = np.frombuffer(b"".join(bodies) + bytes(8 * width + 8), np.uint8)
    at, rest = (np.cumsum(sizes) - sizes)[body] + place, sizes[body] - place
    eights = np.lib.stride_tricks.sliding_window_view(view, 8)
    keep = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9)], np.uint64)
    words = [eights[at + 8 * k].view(">u8").ravel().astype(np.uint64) & keep[np.clip(rest - 8 * k, 0, 8)] for k in range(width)]
    order = np.lexsort((rest, *words[::-1])) if len(at) else np.zeros(0, np.int64)
    common = np.full(max(len(order) - 1, 0), 8 * width)
    for k in range(width - 1, -1, -1):
        apart = words[k][order[1:]] ^ words[k][order[:-1]]
        lead = sum((apart < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(1, 8))
        common = np.where(apart != 0, 8 * k + lead, common)
    common = np.minimum(common, np.minimum(rest[order[1:]], rest[order[:-1]]))
    left = np.where(place > 0, view[np.maximum(at - 1, 0)].astype(np.int64), -1 - body)
    return body[order], place[order], common, left[order]


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the common-prefix tree, from ``least`` bytes, whose suffixes differ to the left.

    A stack holds the open intervals while the array of common prefixes is scanned; an interval closes where the prefix gets shorter.
    """
    change = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    long = common >= least
    edges = np.flatnonzero(np.diff(np.r_[False, long, False].astype(np.int8)))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stack: list[tuple[int, int]] = []
        for at, depth in enumerate([*common[start:end].tolist(), 0], start):
            begin = at
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if change[at] != change[begin]:
                    yield length, begin, at
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one slot each, from batches in the order of slots."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        slot = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
        for s, e in zip(cuts, cuts[1:]):
            if held and e > s and held[-1].column(0)[0].as_py() != slot[s]:
                yield pa.Table.from_batches(held)
                held = []
            if e > s:
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _batches_of_keys(keys: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the bodies whose key has several bodies, whole keys together, some SUFFIXES suffixes at a time."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]][: len(order)])
    held, size = [], 0
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        if e - s > 1:
            held.append(order[s:e])
            size += int(weights[order[s:e]].sum())
            if size >= SUFFIXES:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


class Slot:
    """Stretches of a slot: the different bodies, the least rank of each, and the maximal repeats among those of one gram."""

    def __init__(self, table: pa.Table, least: int):
        coded = table.column("body").combine_chunks().dictionary_encode()
        self.least, self.bodies = least, coded.dictionary.to_pylist()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rank = _ranks(table.column("owner"))
        self.best = np.full(len(self.bodies), np.iinfo(np.int64).max)
        np.minimum.at(self.best, self.code, self.rank)
        self.key = np.zeros(len(self.bodies), np.int64)
        self.key[self.code] = table.column("key").to_numpy()

    def repeats(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, bodies and places of each group of occurrences. Bodies alone with their gram are not among them."""
        weights = np.array([len(b) - self.least + 1 for b in self.bodies], np.int64)
        for own in _batches_of_keys(self.key, weights):
            body, place, common, left = suffix_array([self.bodies[k] for k in own.tolist()], self.least)
            for length, first, last in maximal_repeats(common, left, self.least):
                yield length, own[body[first: last + 1]], place[first: last + 1]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, size) inside the rows' bodies of what a smaller document also holds."""
        later = np.flatnonzero(self.rank > self.best[self.code])
        sizes = np.array([len(b) for b in self.bodies], np.int64)
        rows, starts, lengths = [later], [np.zeros(len(later), np.int64)], [sizes[self.code[later]]]
        bodies, places, long = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, body, place in self.repeats():
            behind = self.best[body] > self.best[body].min()
            if behind.any():
                bodies.append(body[behind])
                places.append(place[behind])
                long.append(np.full(int(behind.sum()), length))
        body, place, long = np.concatenate(bodies), np.concatenate(places), np.concatenate(long)
        if len(body):
            lead = np.flatnonzero(self.rank == self.best[self.code])
            lead = lead[np.argsort(self.code[lead], kind="stable")]
            low, high = np.searchsorted(self.code[lead], body, "left"), np.searchsorted(self.code[lead], body, "right")
            n = high - low
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            rows.append(lead[at])
            starts.append(np.repeat(place, n))
            lengths.append(np.repeat(long, n))
        row, start, size = np.concatenate(rows), np.concatenate(starts), np.concatenate(lengths)
        return _unions(row, start, size, np.arange(len(self.code) + 1) * (int(sizes.max(initial=0)) + 1))


def _by_slot(sent: DataFrame) -> DataFrame:
    return sent.repartition("slot").sortWithinPartitions("slot")


def _spans(sent: DataFrame, least: int) -> DataFrame:
    """(chunk, nth, start, size): repeats of a smaller document's bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "nth", "start", "size"]
        for table in _slots(batches):
            settled = pc.is_null(table.column("body"))
            yield from table.filter(settled).select(names).to_batches()
            open_ = table.filter(pc.invert(settled))
            if open_.num_rows:
                row, start, size = Slot(open_, least).spans()
                at = {c: open_.column(c).to_numpy()[row] for c in ("chunk", "nth", "start")}
                yield pa.RecordBatch.from_arrays([pa.array(at["chunk"]), pa.array(at["nth"]), pa.array(at["start"] + start), pa.array(size)], names)

    columns = ["slot", "key", "chunk", "nth", "owner", "start", "size", "body"]
    return map_arrow(_by_slot(sent.select(columns)), rows, "chunk long, nth long, start long, size long")


def _prepared(docs: DataFrame, least: int, merge: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunks of ``docs``, which texts are copies, and what the others send."""
    chunks = _chunks(docs)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits = min(20, (total // BUCKET_BYTES).bit_length())
    copies = cut_lineage(_copies(chunks))
    shared = _shared_grams(chunks, copies, bits, least)
    return chunks, copies, _sent(chunks, copies, shared, bits, 1 + total // SLOT_BYTES, least, merge)


def merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unions of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order]) if len(order) else start[order]
    new = np.r_[True, start[1:] > end[:-1]][: len(start)]
    return start[new], np.maximum.reduceat(end, np.flatnonzero(new)) if len(start) else end


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans) for every row of ``docs``; ``text`` holds the bytes that are left.

    A byte goes if a string of ``least`` bytes that covers it also starts in a document with a smaller doc_id. Strings are judged on the
    input and never cross documents. Null and empty texts have no bytes; documents with the same doc_id are not smaller than
    each other, a null doc_id is larger than all others; repeated rows give repeated results. Other columns are not read. A text
    is worked on in one task. Hashes only bring stretches together: they are compared byte by byte before they count. Copies of whole texts
    are told by SHA-256.
    """
    chunks, copies, sent = _prepared(docs, least, True)
    spans = _spans(sent, least).unionByName(copies.where(F.col("size") >= least).select("chunk", "nth", F.lit(0).cast("long").alias("start"), "size"))
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text binary, n_bytes long, n_removed long, n_spans long"

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        nth, start, size = (right.column(c).to_numpy() for c in ("nth", "start", "size"))
        order = np.argsort(nth, kind="stable")
        nth, start, size = nth[order], start[order], size[order]
        kept, figures = [], []
        for number, text in zip(left.column("nth").to_pylist(), left.column("text")):
            text = text.as_py() or b""
            s, e = np.searchsorted(nth, number, "left"), np.searchsorted(nth, number, "right")
            begin, end = merged(start[s:e], size[s:e])
            figures.append((len(text), int((end - begin).sum()), len(begin)))
            kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)])) if len(begin) else text)
        counts = np.array(figures, np.int64).reshape(-1, 3)
        return pa.Table.from_arrays([left.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(counts[:, k]) for k in range(3))], ["doc_id", "text", "n_bytes", "n_removed", "n_spans"])

    return chunks.select("chunk", "nth", "doc_id", "text").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(rows, schema)


def repeat_groups(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(group_id, length, doc_id, start): every occurrence of each maximal repeat of ``least`` bytes or more within a stretch.

    A repeat longer than a stretch comes as several groups that overlap. Occurrences that a chunk folds join their chief's groups here, and
    so do copies of whole texts. A text that only its copies repeat has no group.
    """
    chunks, copies, sent = _prepared(docs, least, False)
    sent = written(sent, "stretches")
    schema = "group_id string, length long, chunk long, nth long, run long, place long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slots(batches):
            slot = Slot(table, least)
            chunk, nth, start = (table.column(c).to_numpy() for c in ("chunk", "nth", "start"))
            order = np.argsort(slot.code, kind="stable")
            low = np.searchsorted(slot.code[order], np.arange(len(slot.bodies) + 1))
            # Whole bodies first: a group for each, whose other occurrences may lie in the same chunk.
            groups = [(len(b), np.array([k]), np.array([0])) for k, b in enumerate(slot.bodies)]
            for number, (length, body, place) in enumerate([*groups, *slot.repeats()]):
                at = np.concatenate([order[low[b]: low[b + 1]] for b in body.tolist()])
                inside = np.repeat(place, low[body + 1] - low[body])
                name = f"{table.column('slot')[0].as_py()}-{number}"
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), length)), *(pa.array(x) for x in (chunk[at], nth[at], start[at], inside))],
                                                 ["group_id", "length", "chunk", "nth", "run", "place"])

    found = map_arrow(_by_slot(sent.where("body IS NOT NULL").drop("chief_nth", "chief_start")), rows, schema)
    folded = sent.where("body IS NULL").select("chunk", F.col("chief_nth").alias("nth"), F.col("chief_start").alias("run"), F.col("nth").alias("own_nth"), F.col("start").alias("own_run"))
    more = found.join(folded, ["chunk", "nth", "run"]).select("group_id", "length", "chunk", F.col("own_nth").alias("nth"), F.col("own_run").alias("run"), "place")
    # Copies have the groups of the text they repeat.
    texts = chunks.select("chunk", "nth", "doc_id", "digest")
    first = texts.join(copies.select("chunk", "nth"), ["chunk", "nth"], "left_anti")
    every = found.unionByName(more).join(first.select("chunk", "nth", "doc_id", "digest"), ["chunk", "nth"])
    again = every.drop("doc_id").join(texts.join(copies.select("chunk", "nth"), ["chunk", "nth"], "left_semi").select("digest", "doc_id"), "digest")
    every = every.select("group_id", "length", "doc_id", (F.col("run") + F.col("place")).alias("start")).unionByName(
        again.select("group_id", "length", "doc_id", (F.col("run") + F.col("place")).alias("start")))
    several = every.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return every.join(several, "group_id")
