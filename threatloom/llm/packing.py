"""Packing token sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import json
import os
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threatloom.llm.common import map_arrow, text_bytes, written

SEQUENCE, END_ID = 2048, 1
#: Documents of one rank bucket, about.
BUCKET = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Words remembered in each of two generations.
REMEMBERED = 700_000
#: Bytes of text split at once.
SPLIT_AT = 4 << 20

_ASCII_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _ends_in_letter(start: bytes) -> bool:
    """Some letters become a letter and a mark in the tokenizer's normal form; an ASCII letter stays one."""
    last = start[-1:]
    if last.isascii():
        return last.isalpha()
    return unicodedata.normalize("NFC", start.decode("utf-8", "replace")[-1:]).lower()[-1:].isalpha()


class _WordIds:
    """Little-endian ids of words between white space, remembered across tasks of a Python worker.

    White space always ends a token of this tokenizer and is dropped by it, so a text's ids are those of its words in a row. So are a
    word's those of its start up to its last letter and of the ASCII marks after that. ASCII capitals change nothing, but in a text where
    they could spell a special token. Only starts not met before go to the tokenizer. When the young generation is full it becomes the old one, so words in use stay.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(SparkFiles.get(file))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Afterwards every one of ``words`` is young."""
        if len(self.young) + len(words) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        parts: dict[bytes, tuple[bytes, ...]] = {}
        for word in words - young.keys():
            if (known := old.get(word)) is not None:
                young[word] = known
                continue
            start = word.rstrip(_ASCII_MARKS)
            whole = start == word or b"<|" in word or not _ends_in_letter(start)
            parts[word] = (word,) if whole else (start, word[len(start):])
        new = [w for w in {p for own in parts.values() for p in own} if w not in young and w not in old]
        for at in range(0, len(new), 8192):
            chunk = new[at: at + 8192]
            for word, code in zip(chunk, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in chunk], add_special_tokens=False)):
                young[word] = struct.pack(f"<{len(ids := code.ids)}I", *ids)
        for word, own in parts.items():
            young[word] = b"".join([young.get(p) if p in young else old[p] for p in own])

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            size, split = 0, []
            while at < len(texts) and (size < SPLIT_AT or not split):
                text = texts[at]
                split.append((text if b"<|" in text else text.lower()).split())
                size += len(texts[at])
                at += 1
            self.learn(set().union(*split))
            known = self.young.__getitem__
            for words in split:
                yield b"".join(map(known, words))


class _WholeIds:
    """The same for a tokenizer that keeps white space: each text goes to it whole."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(SparkFiles.get(file))

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


@cache
def _coder(file: str, whole: bool) -> _WordIds | _WholeIds:
    return (_WholeIds if whole else _WordIds)(file)


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer file drops white space between tokens, as ``_WordIds`` needs."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut every ``sequence`` ids.

    ``tokenizer`` is the path of a tokenizer file on the driver; Spark ships it to the executors. Null texts are empty.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    file, whole = tokenizer.rsplit("/", 1)[-1], not splits_at_spaces(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file, whole)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.ids([t or b"" for t in batch.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    part = ids[4 * start: 4 * (start + sequence)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [f.split()[0] for f in PIECES.split(", ")])

    return map_arrow(docs.select("doc_id", text_bytes()), rows, PIECES)


def shortest_pack_first(counts: dict[int, int], sequence: int = SEQUENCE) -> dict[tuple[int, ...], int]:
    """Packing patterns (lengths in the order placed) and how many sequences have each.

    Lengths are placed longest first. The documents of a length go to the emptiest patterns that can take them; a pattern with
    more sequences than documents left is split in two. Only counts move, never documents, so the work depends on the
    number of lengths, not on that of documents.
    """
    patterns: Counter[tuple[int, ...]] = Counter()
    by_room: dict[int, list[tuple[int, ...]]] = {}
    rooms: list[int] = []  # negated, a heap: most room first

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = sequence - sum(pattern)
        if not patterns[pattern]:
            if not by_room.setdefault(room, []):
                heapq.heappush(rooms, -room)
            by_room[room].append(pattern)
        patterns[pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        placed: Counter[tuple[int, ...]] = Counter()
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            own = by_room[room]
            while own and left:
                pattern = own[-1]
                n = min(left, patterns[pattern])
                patterns[pattern] -= n
                if not patterns[pattern]:
                    del patterns[pattern]
                    own.pop()
                # A pattern may take the same length again while there is room, so it goes back at once.
                grown = (*pattern, length)
                if room - length == room:
                    raise ValueError("lengths are positive")
                placed[grown] += n
                left -= n
            if not own:
                heapq.heappop(rooms)
            if left and -(rooms[0] if rooms else 0) < length or not left:
                for grown, n in placed.items():
                    put(grown, n)
                placed = Counter()
        for grown, n in placed.items():
            put(grown, n)
        if left:
            fit = sequence // length
            # New sequences take the length alone; equal lengths share one only when no emptier place is left.
            full, rest = divmod(left, fit)
            if full:
                put((length,) * fit, full)
            if rest:
                put((length,) * rest, 1)
    return {p: n for p, n in patterns.items() if n}


class Layout:
    """Where the r-th document of a length goes: patterns in a fixed order, each holding consecutive sequences."""

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        keys: list[tuple[int, int, int, int, tuple[int, ...]]] = []
        used: Counter[int] = Counter()
        base = 0
        for pattern in sorted(patterns, reverse=True):
            n, offsets, at = patterns[pattern], {}, 0
            for length in pattern:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, places in offsets.items():
                keys.append((length, used[length], base, len(places), tuple(places)))
                used[length] += n * len(places)
            base += n
        keys.sort()
        self.length = np.array([k[0] for k in keys], np.int64)
        self.first = np.array([k[1] for k in keys], np.int64)
        self.base = np.array([k[2] for k in keys], np.int64)
        self.places = np.array([k[3] for k in keys], np.int64)
        self.at = np.r_[0, np.cumsum(self.places)][:-1] if keys else np.zeros(0, np.int64)
        self.offsets = np.array([o for k in keys for o in k[4]], np.int64)
        self.heads = np.r_[np.flatnonzero(np.r_[True, self.length[1:] != self.length[:-1]]), len(keys)] if keys else np.zeros(1, np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets."""
        row = np.empty(len(length), np.int64)
        lengths = self.length[self.heads[:-1]]
        group = np.searchsorted(lengths, length)
        for g in np.unique(group):
            own = group == g
            s, e = self.heads[g], self.heads[g + 1]
            row[own] = s + np.searchsorted(self.first[s:e], rank[own], side="right") - 1
        inside = rank - self.first[row]
        return self.base[row] + inside // self.places[row], self.offsets[self.at[row] + inside % self.places[row]]


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece; every id lies in exactly one piece.

    Texts are tokenized once; the pieces, a few numbers each, are written. The histogram of lengths has at most ``sequence`` rows,
    whatever the corpus, so the patterns are made on the driver and travel as a table of bounded size. Pieces find their place by
    their rank among those of their length: a count per length and bucket of ids, then a row number inside each bucket, so a
    length shared by a third of all pieces is dealt over many buckets. Rows that share a doc_id are packed one by one; a null
    doc_id stays null. An empty table gives no pieces, an empty text one piece with the end id alone.
    """
    parts = written(pieces(docs, tokenizer, sequence), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = docs.sparkSession.sparkContext.broadcast(Layout(shortest_pack_first(counts, sequence)))
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET))
    slotted = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = slotted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    heads = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("head"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = slotted.withColumn("nth", inside).join(heads, ["length", "bucket"]).select(
        *(f.split()[0] for f in PIECES.split(", ")), (F.col("head") + F.col("nth") - 1).alias("rank"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = layout.value.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, rows, f"{PIECES}, sequence_id long, offset long")
