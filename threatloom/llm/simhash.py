"""SimHash near-duplicates found with anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatloom.llm.common import fresh, map_arrow, text_bytes, words_of, written
from threatloom.llm.components import connected_components
from threatloom.session import cut_lineage

SEED = 42
#: Fingerprints compared at once on the side that streams past the homes of an anchor.
TILE = 512
#: Close pairs of a tile from which it pays to look whether they have met before.
CROWD = 2048
#: Proposed pairs from which a task hands them on.
OUT = 1 << 16
#: Long columns of a parity sketch.
SKETCH = [f"s{k}" for k in range(16)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass(frozen=True)
class Segment:
    """Bits whose anchors are the words of a perfect Hamming code (covering radius 1) times all values of the raw bits.

    ``block`` has 15 or 31 bit numbers. Up to ``allowed`` errors are met: in the block only, or also in the raw bits.
    """

    block: tuple[int, ...]
    raw: tuple[int, ...]
    allowed: int
    raw_errors: bool = True


@dataclass(frozen=True)
class Layout:
    """Fingerprint width (64 or 128), the most differing bits of a link, and the segments searched."""

    bits: int
    distance: int
    segments: tuple[Segment, ...]


#: Exact: 4 differing bits leave at most 2 in the first segment or at most 1 in the second. About 174 rows a fingerprint.
EXACT_4_OF_64 = Layout(64, 4, (Segment(tuple(range(31)), (), 2), Segment(tuple(range(31, 62)), (62, 63), 1)))


def sampled_layout(bits: int, distance: int, segments: int, raw: int, seed: int = 7, allowed: int = 1) -> Layout:
    """Segments of 15 + ``raw`` bits drawn at random, for distances that no exact split reaches.

    With ``allowed`` 1 (8 rows a segment) a pair whose bits differ with probability p meets in a segment with
    ((1-p)^15 + 15 p (1-p)^14) (1-p)^raw; with 0 (1 row, both have the same home) with
    ((1-p)^15 + 15/8 p (1-p)^14 + 105/8 p^2 (1-p)^13) (1-p)^raw, which is more for the same number of rows.
    """
    draw = np.random.default_rng(seed)
    picks = [tuple(draw.permutation(bits)[: 15 + raw].tolist()) for _ in range(segments)]
    return Layout(bits, distance, tuple(Segment(p[:15], p[15:], allowed, raw_errors=False) for p in picks))


#: Least Jaccard similarity of the shingle sets of a link in ``keep_one``.
SIMILARITY = 0.8
#: Proposes pairs of that similarity: 15 % of their bits differ on average, 32 of 128 is three deviations more.
SIMILAR_08 = sampled_layout(128, 32, 128, 5, allowed=0)


def shingle_hashes(words: list[bytes], width: int, bits: int) -> np.ndarray:
    """Hash of every run of ``width`` words (of the whole text if it has fewer), repeats included, as bytes in rows.

    64 bits: XXH64 with seed 42; 128 bits: XXH3.
    """
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        ends = list(accumulate(map(len, words), lambda end, n: end + n + 1))
        spans = zip([0, *(e + 1 for e in ends[: len(words) - width])], ends[width - 1:])
    if bits == 64:
        digest = xxhash.xxh64_intdigest
        return np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8").view(np.uint8).reshape(-1, 8)
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 16)


def fingerprint(text: bytes | None, width: int, bits: int = 64, once: bool = False) -> bytes:
    """Little-endian fingerprint; a bit is set if it is set in over half the hashes, repeats dropped if ``once``. No words: zero."""
    words = words_of(text)
    if not words:
        return bytes(bits // 8)
    hashes = shingle_hashes(words, width, bits)
    if once:
        hashes = hashes[np.unique(hashes.view("<u8")[:, 0], return_index=True)[1]]
    size = bits // 8
    slots = (hashes + (np.arange(size) * 256).astype(np.uint16)).ravel()
    ones = np.bincount(slots, minlength=256 * size).reshape(size, 256) @ _BITS
    return np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, once: bool = False) -> DataFrame:
    """(doc_id, fp, fp_high): the fingerprint's low and high 64 bits as signed longs; null and empty texts have zero."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t, width, bits, once).ljust(16, b"\0") for t in batch.column(1).to_pylist())
            halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "fp", "fp_high"])

    frame = docs.select("doc_id", text_bytes())
    return map_arrow(frame, rows, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp long, fp_high long")


@cache
def _patterns(length: int, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the error patterns of at most radius + ``allowed`` bits that lead to a code word, and a mask of real entries.

    The first pattern of each syndrome has at most one bit: it leads to the word's home.
    """
    by: list[list[int]] = [[] for _ in range(length + 1)]
    for n in range(allowed + 2):
        for bits in combinations(range(length), n):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1
            by[syndrome].append(sum(1 << b for b in bits))
    most = max(map(len, by))
    return np.array([x + [0] * (most - len(x)) for x in by], np.uint64), np.array([[k < len(x) for k in range(most)] for x in by])


def _gather(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    found = np.zeros(len(prints), np.uint64)
    for at, bit in enumerate(bits):
        found |= ((prints[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)) << np.uint64(at)
    return found


def _syndromes(words: np.ndarray, length: int) -> np.ndarray:
    found = np.zeros(len(words), np.int64)
    for bit in range(length):
        found ^= ((words >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * (bit + 1)
    return found


def anchors_of(prints: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Keys and row numbers of all replicas. Key: segment, raw bits, code word, then 0 at the home and 1 elsewhere."""
    keys, owners = [], []
    everyone = np.arange(len(prints))
    for number, segment in enumerate(layout.segments):
        length = len(segment.block)
        block, raw = _gather(prints, segment.block), _gather(prints, segment.raw)
        syndrome = _syndromes(block, length)
        for n in range(min(len(segment.raw), segment.allowed if segment.raw_errors else 0) + 1):
            pattern, real = _patterns(length, segment.allowed - n)
            for flips in combinations(range(len(segment.raw)), n):
                value = raw ^ np.uint64(sum(1 << b for b in flips))
                word = ((block[:, None] ^ pattern[syndrome]) | (value << np.uint64(length))[:, None] | np.uint64(number << 40)) << np.uint64(1)
                word[:, 1:] |= np.uint64(1)
                if n:
                    word[:, 0] |= np.uint64(1)
                mask = real[syndrome]
                keys.append(word[mask])
                owners.append(np.broadcast_to(everyone[:, None], mask.shape)[mask])
    return np.concatenate(keys), np.concatenate(owners)


def _columns(batch: pa.RecordBatch, first: int, count: int = 2) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(first, first + count)], axis=1)


class _Forest:
    """Which members of an anchor hang together so far."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.outside = 0

    def outsiders(self, n: int) -> int:
        """The first of ``n`` fresh names, below zero, for members that are no homes."""
        self.outside += n
        return -self.outside

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y

    def links(self, near: np.ndarray, rows: list, columns: list) -> tuple[list[int], list[int]]:
        """Enough of the links in the matrix ``near`` to join all that it joins, found by merging: each pass links every group of
        rows at most once, so a tile of n members costs some n steps and not n squared. ``rows``, ``columns``: names."""
        left: list[int] = []
        right: list[int] = []
        while True:
            a, b = np.array([self.root(x) for x in rows]), np.array([self.root(x) for x in columns])
            apart = near & (a[:, None] != b[None, :])
            found = np.flatnonzero(apart.any(axis=1))
            if not len(found):
                return left, right
            for i, j in zip(found.tolist(), apart[found].argmax(axis=1).tolist()):
                if self.join(rows[i], columns[j]):
                    left.append(i)
                    right.append(j)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each pair."""
    apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    if x[:, 1].any() or y[:, 1].any():
        apart += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
    return apart


def _close(homes: np.ndarray, others: np.ndarray, distance: int, out: list[np.ndarray]) -> None:
    """Link homes with others within the distance, tile by tile; a tile gives a spanning forest of its links."""
    for i in range(0, len(homes), TILE):
        for j in range(0, len(others), TILE):
            x, y = homes[i: i + TILE], others[j: j + TILE]
            apart = _apart(x, y)
            near = (apart <= distance) & (apart > 0)
            if near.any():
                _, name = np.unique(np.r_[x, y], axis=0, return_inverse=True)
                name = name.ravel().tolist()
                left, right = _Forest().links(near, name[: len(x)], name[len(x):])
                out.append(np.c_[x[left], y[right]])


def _meetings(batches: Iterator[pa.RecordBatch], columns: int = 2) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """For each batch of (key, fp, fp_high, ...) in the order of keys, its busy anchors: anchor, homes so far, new homes, others."""
    anchor, homes = None, np.zeros((0, columns), np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _columns(batch, 1, columns)
        place, away = keys >> np.uint64(1), (keys & np.uint64(1)).astype(bool)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        live = ~away[starts]
        live[0] |= anchor is not None and place[0] == anchor
        # A lone home has nobody to meet, unless its anchor goes on in the next batch.
        busy = live & ((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        found = []
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
            if place[s] != anchor:
                anchor, homes = place[s], homes[:0]
            own, others = prints[s:e][~away[s:e]], prints[s:e][away[s:e]]
            homes = np.concatenate([homes, own]) if len(own) else homes
            found.append((int(anchor), homes, own, others))
        if not live[-1]:
            anchor, homes = None, homes[:0]
        yield found


def _replicas(prints: DataFrame, layout: Layout) -> DataFrame:
    """(key, fp, fp_high): every fingerprint at its anchors; an anchor's rows in one task, homes first."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _columns(batch, 0)
            for at in range(0, len(prints), 1024):
                part = prints[at: at + 1024]
                keys, owners = anchors_of(part, layout)
                low, high = part[owners, 0], part[owners, 1]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (keys, low, high)], ["key", "fp", "fp_high"])

    replicas = map_arrow(prints.select("fp", "fp_high"), replicate, "key long, fp long, fp_high long")
    return replicas.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")


def near_links(prints: DataFrame, layout: Layout = EXACT_4_OF_64) -> DataFrame:
    """Edges (a, a_high, b, b_high) between distinct fingerprints, enough to join all that some segment brings together.

    Each fingerprint goes to its home anchor (the code word within the covering radius, 1) and to every anchor within
    radius plus the segment's threshold, so one of two close fingerprints meets the other at its home. The rows that leave
    a distinct fingerprint are a constant of the layout; exact copies are folded before. An anchor's rows arrive sorted,
    homes first, and stream past the homes: memory is the homes of one anchor.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _meetings(batches):
            edges: list[np.ndarray] = []
            for _, homes, own, others in met:
                if len(own):
                    _close(homes, own, layout.distance, edges)
                if len(others):
                    _close(homes, others, layout.distance, edges)
            if edges:
                found = np.concatenate(edges).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], ["a", "a_high", "b", "b_high"])

    return map_arrow(_replicas(prints, layout), compare, "a long, a_high long, b long, b_high long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, layout: Layout = EXACT_4_OF_64) -> DataFrame:
    """(doc_id, fp, fp_high, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of ``layout.distance`` or fewer differing bits. Null
    and empty texts share fingerprint zero and are linked like any other; repeated rows stay; a null doc_id keeps its row
    and never names a component unless all its documents have none. Extra columns are ignored.
    """

    def node(low: str, high: str) -> Column:
        return F.col(low) if layout.bits == 64 else F.concat(F.hex(high), F.lit(":"), F.hex(low))

    prints = written(fingerprints(docs, width, layout.bits), "simhash")
    distinct = prints.groupBy("fp", "fp_high").agg(F.min("doc_id").alias("least"))
    links = near_links(distinct, layout).select(node("a", "a_high").alias("a"), node("b", "b_high").alias("b"))
    roots = connected_components(cut_lineage(links))
    placed = distinct.withColumn("node", node("fp", "fp_high")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "fp_high", "component_id")
    return prints.join(classes, ["fp", "fp_high"]).select("doc_id", "fp", "fp_high", "component_id")


def _candidate_members(prints: DataFrame, layout: Layout) -> DataFrame:
    """The rows of ``_replicas`` that have a partner within the distance at their anchor: linear in the rows, whatever the groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _meetings(batches):
            out: list[np.ndarray] = []
            for anchor, homes, own, others in met:
                seen = np.zeros(len(homes), bool)
                for away, more in ((0, own), (1, others)):
                    near = np.zeros(len(more), bool)
                    for at, left, to, right in _tiles(homes, more, layout.distance):
                        seen[at + left], near[to + right] = True, True
                    if not away:
                        seen[len(homes) - len(own):] |= near
                    elif near.any():
                        out.append(np.c_[np.full(near.sum(), anchor << 1 | 1, np.uint64), more[near]])
                if seen.any():
                    out.append(np.c_[np.full(seen.sum(), anchor << 1, np.uint64), homes[seen]])
            if out:
                found = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], ["key", "fp", "fp_high"])

    return map_arrow(_replicas(prints, layout), rows, "key long, fp long, fp_high long")


def _tiles(homes: np.ndarray, others: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Tile by tile, first home and numbers from it, first other and numbers from it, of distinct pairs within the distance."""
    for i, j, near in _near_tiles(homes, others, distance):
        left, right = np.nonzero(near)
        yield i, left, j, right


def _near_tiles(homes: np.ndarray, others: np.ndarray, distance: int, own: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """First home, first other and the matrix of pairs within the distance but not equal. ``own``: the others are the last homes, so a
    pair comes once."""
    start = len(homes) - len(others)
    for i in range(0, len(homes), TILE):
        for j in range(0, len(others), TILE):
            if own and i >= start + j + TILE:
                continue
            apart = _apart(homes[i: i + TILE], others[j: j + TILE])
            near = (apart <= distance) & (apart > 0)
            if own:
                near &= np.arange(i, i + near.shape[0])[:, None] < np.arange(start + j, start + j + near.shape[1])[None, :]
            if near.any():
                yield i, j, near


def _home_keys(prints: np.ndarray, layout: Layout) -> np.ndarray:
    """Home of each fingerprint in each segment, one row a fingerprint."""
    plain = Layout(layout.bits, layout.distance, tuple(Segment(s.block, s.raw, 0, raw_errors=False) for s in layout.segments))
    return anchors_of(prints[:, :2], plain)[0].reshape(len(layout.segments), len(prints)).T


def _met_before(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, segment: int) -> np.ndarray:
    """Which pairs (numbers of home rows) also share a home in an earlier segment."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 12):
        own, other = left[at: at + (1 << 12)], right[at: at + (1 << 12)]
        out[at: at + (1 << 12)] = (x[own, :segment] == y[other, :segment]).any(axis=1)
    return out


def _nearest(near: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of the matrix in which one is among the ``most`` nearest of the other, and whether these are all."""
    left, right = np.nonzero(near)
    bits, keep = apart[left, right], np.zeros(len(left), bool)
    for side in (left, right):
        order = np.lexsort((bits, side))
        starts = np.flatnonzero(np.r_[True, side[order][1:] != side[order][:-1]])
        sizes = np.diff(np.r_[starts, len(order)])
        keep[order[np.arange(len(order)) - np.repeat(starts, sizes) < most]] = True
    return left[keep], right[keep], bool(keep.all())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit a slot: whether an odd number of the set's hashes fall into it. The differing bits of two sketches are at most the
    hashes that only one of the two sets has."""
    bits = len(SKETCH) * 64
    counts = np.bincount((shingles.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _surely_apart(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (numbers of rows of size and sketch) cannot reach the Jaccard similarity. Sets that reach it differ in at most
    (1 - similarity) / (1 + similarity) of the sum of their sizes, and in no less than their sketches or sizes do."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 12):
        own, other = x[left[at: at + (1 << 12)]], y[right[at: at + (1 << 12)]]
        sizes = own[:, 0].astype(np.int64), other[:, 0].astype(np.int64)
        least = np.maximum(np.bitwise_count(own[:, 1:] ^ other[:, 1:]).sum(axis=1, dtype=np.int64), np.abs(sizes[0] - sizes[1]))
        out[at: at + (1 << 12)] = least * (1 + similarity) > (sizes[0] + sizes[1]) * (1 - similarity) + 1e-6
    return out


def _proposals(members: DataFrame, layout: Layout, most: int, similarity: float | None = None) -> DataFrame:
    """(a, a_high, b, b_high, cut): pairs of ``members(key, fp, fp_high, label)`` whose labels differ.

    With a ``similarity`` members also have the size and the sketch of their shingle sets, and pairs that cannot reach it are left out.
    ``most`` 0: a spanning forest at each anchor. Else a member's ``most`` nearest others in a tile; cut tells that there are more.
    Where each fingerprint is at its homes alone, the pairs of a crowded tile count at the first home they share and at no other; those of
    other tiles may come several times and are folded behind the shuffle.
    """
    distance, alone = layout.distance, all(s.allowed == 0 for s in layout.segments)

    def batch_of(out: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(out).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(5)], ["a", "a_high", "b", "b_high", "cut"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, forest = None, _Forest()
        for met in _meetings(batches, 3 if similarity is None else 4 + len(SKETCH)):
            out: list[np.ndarray] = []
            for anchor, homes, own, others in met:
                if anchor != last:
                    last, forest = anchor, _Forest()
                for more, inner in ((own, True), (others, False)):
                    first = len(homes) - len(more) if inner else forest.outsiders(len(more))
                    for at, to, near in _near_tiles(homes, more, distance, inner):
                        x, y = homes[at: at + TILE], more[to: to + TILE]
                        near &= x[:, None, 2] != y[None, :, 2]
                        if similarity is not None:
                            left, right = np.nonzero(near)
                            apart = _surely_apart(x[:, 3:], y[:, 3:], left, right, similarity)
                            near[left[apart], right[apart]] = False
                        if alone and np.count_nonzero(near) > CROWD:
                            left, right = np.nonzero(near)
                            before = _met_before(_home_keys(x, layout), _home_keys(y, layout), left, right, anchor >> 40)
                            near[left[before], right[before]] = False
                        if not near.any():
                            continue
                        whole = True
                        if most:
                            left, right, whole = _nearest(near, _apart(x, y), most)
                        else:
                            left, right = forest.links(near, list(range(at, at + len(x))), list(range(first + to, first + to + len(y))))
                        x, y = x[left], y[right]
                        swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
                        x, y = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
                        out.append(np.c_[x[:, :2], y[:, :2], np.full(len(x), not whole, np.uint64)])
                        if sum(map(len, out)) >= OUT:
                            yield batch_of(out)
                            out.clear()
            if out:
                yield batch_of(out)

    dealt = members.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "fp", "fp_high")
    pairs = map_arrow(dealt, rows, "a long, a_high long, b long, b_high long, cut long")
    return pairs.groupBy("a", "a_high", "b", "b_high").agg(F.max("cut").alias("cut"))


def _shingle_sets(needed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(face, shingles, size, sketch columns) of the texts whose digests are in ``needed(face)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            sets = [np.unique(shingle_hashes(w, width, 64).view("<i8")[:, 0]) if w else np.zeros(0, np.int64) for w in words]
            marks = np.stack([parity_sketch(x) for x in sets]) if sets else np.zeros((0, len(SKETCH)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, marks.T.copy())],
                ["face", "shingles", "size", *SKETCH])

    texts = docs.select(_face().alias("face"), text_bytes()).join(needed.distinct(), "face", "left_semi").groupBy("face").agg(F.first("text").alias("text"))
    return written(map_arrow(texts, rows, ", ".join(["face binary, shingles array<long>, size long", *(f"{c} long" for c in SKETCH)])), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs(x, y, ...)`` of text digests and whether the shingle sets of both texts reach the similarity, as ``similar``."""
    both = pairs.join(sets.select(F.col("face").alias("x"), F.col("shingles").alias("own")), "x").join(
        sets.select(F.col("face").alias("y"), F.col("shingles").alias("other")), "y")
    shared = F.size(F.array_intersect("own", "other"))
    enough = shared >= F.lit(similarity) * (F.size("own") + F.size("other") - shared)
    return both.select(*pairs.columns, enough.alias("similar"))


def _face() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def similar_groups(docs: DataFrame, width: int = 5, layout: Layout = SIMILAR_08, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: groups over links between texts whose sets of distinct ``width``-word
    shingles (as 64-bit hashes) have at least the Jaccard similarity.

    Fingerprints of those sets meet at the anchors; a meeting only proposes. One text of each fingerprint stands for it, its other
    texts are checked against that one and stay alone if they fail. Proposals go in rounds: first a spanning forest at each anchor,
    then each text's nearest ones in other groups, more and more of them, until all such pairs have been checked. A pair whose sketches
    show that it is below the similarity is not proposed. So a family of n close texts costs some n checks and each pair that could
    join something is checked.
    """
    prints = written(fingerprints(docs.select(F.struct("doc_id", _face().alias("face")).alias("doc_id"), "text"), width, layout.bits, once=True), "similar")
    prints = prints.select("doc_id.*", "fp", "fp_high")
    texts = prints.groupBy("fp", "fp_high", "face").agg(F.min("doc_id").alias("least"))
    faces = texts.groupBy("fp", "fp_high").agg(F.min("face").alias("face"))
    members = written(_candidate_members(faces, layout), "members")
    sets = _shingle_sets(members.select("fp", "fp_high").distinct().join(faces, ["fp", "fp_high"]).select("face"), docs, width)
    members = written(members.join(faces, ["fp", "fp_high"]).join(sets.drop("shingles"), "face").drop("face"), "sketched")
    own = F.concat(F.hex("fp_high"), F.lit(":"), F.hex("fp"))
    schema = "a long, a_high long, b long, b_high long, similar boolean"
    checked, roots, most, links = docs.sparkSession.createDataFrame([], schema), None, 0, None
    while True:
        if roots is None:
            labelled = members.withColumn("label", F.xxhash64("fp", "fp_high"))
        else:
            named = roots.select(F.col("node").alias("name"), "root")
            labelled = members.withColumn("name", own).join(named, "name", "left").withColumn(
                "label", F.xxhash64(F.coalesce("root", "name")))
        labelled = labelled.select("key", "fp", "fp_high", "label", "size", *SKETCH)
        proposed = written(_proposals(labelled, layout, most, similarity), "proposed")
        pairs = proposed.join(checked, ["a", "a_high", "b", "b_high"], "left_anti")
        for end, face in (("a", "x"), ("b", "y")):
            pairs = pairs.join(faces.select(F.col("fp").alias(end), F.col("fp_high").alias(f"{end}_high"), F.col("face").alias(face)), [end, f"{end}_high"])
        pairs = written(pairs.select("a", "a_high", "b", "b_high", "x", "y"), "pairs")
        fresh_pairs = pairs.count()
        if fresh_pairs:
            result = written(_similar(pairs, sets, similarity).select("a", "a_high", "b", "b_high", "similar"), "checked")
            checked = checked.unionByName(result)
            links = checked.where("similar").select(
                F.concat(F.hex("a_high"), F.lit(":"), F.hex("a")).alias("a"), F.concat(F.hex("b_high"), F.lit(":"), F.hex("b")).alias("b"))
            roots = cut_lineage(connected_components(cut_lineage(links)))
        elif most and not proposed.where("cut = 1").limit(1).count():
            break
        elif not most and not proposed.limit(1).count():
            break
        most = most * 8 if most else 8
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node string, root string")
    beside = texts.join(faces.withColumnRenamed("face", "x"), ["fp", "fp_high"]).where("face <> x").select("fp", "fp_high", "x", F.col("face").alias("y"))
    beside = written(beside, "beside")
    ends = beside.select(F.col("x").alias("face")).unionByName(beside.select(F.col("y").alias("face")))
    apart = _similar(beside, _shingle_sets(ends, docs, width), similarity).where("not similar").select("fp", "fp_high", F.col("y").alias("face"), F.lit(True).alias("alone"))
    placed = texts.join(written(apart, "apart"), ["fp", "fp_high", "face"], "left").withColumn("node", own).join(roots, "node", "left").withColumn(
        "root", F.when(F.col("alone"), F.concat("node", F.lit(":"), F.hex("face"))).otherwise(F.coalesce("root", "node")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "fp_high", "face", "component_id")
    return prints.join(classes, ["fp", "fp_high", "face"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, layout: Layout = SIMILAR_08) -> DataFrame:
    """The document with the smallest doc_id of each group of ``similar_groups``, with all its columns.

    doc_id names a document: of rows that repeat it the first by text, lang and source stays. Rows without a doc_id stay.
    """
    leads, nth = fresh(docs, "leads"), fresh(docs, "nth")
    leaders = similar_groups(docs, width, layout).where("doc_id = component_id").select("doc_id", F.lit(True).alias(leads)).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source"))
    kept = docs.join(leaders, "doc_id", "left").where(F.col(leads) | F.col("doc_id").isNull()).withColumn(nth, first)
    return kept.where((F.col(nth) == 1) | F.col("doc_id").isNull()).select(*docs.columns)
