"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatloom.llm.common import fresh, map_arrow, text_bytes, words_of

WIDTH, CONTAINMENT = 5, 0.8
#: MinHash functions; each is a band of its own.
HASHES = 48
#: Items of one pass over the documents, by number of shingles: what is broadcast stays below some 50 MB whatever the benchmark.
BLOCK_SHINGLES = 200_000
#: Least window step, in shingles, and shingles hashed at once.
STEP, CHUNK = 8, 1 << 19
#: Items of at most so many shingles fill too little of a window of three steps: their codes are looked up one by one.
SHORT = STEP

_DRAW = np.random.default_rng(11)
_ODD = _DRAW.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1
_MASK = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * 2 + 1
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Runs of ``width`` words; fewer words are one shingle, none are none."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i: i + width]) for i in range(len(words) - width + 1)]


class _WordHashes(dict):
    """Hash of a word, remembered; forgotten all at once before it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_codes(words: list[bytes], known: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """32-bit codes of the shingles, in order."""
    if not words:
        return np.zeros(0, np.uint32)
    h = np.array([known[w] for w in words], np.uint64)
    span = min(width, len(words))
    out = np.zeros(len(h) - span + 1, np.uint64)
    for k in range(span):
        out = (out ^ h[k: k + len(out)]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def _size_class(n: int) -> int:
    """Window step, half the least power of two that holds ``n`` shingles, at least STEP."""
    return max(STEP, 1 << max(0, (n - 1).bit_length() - 1))


class ItemIndex:
    """Signatures of a block of items by size class, codes of the short ones, and the shingles of all."""

    def __init__(self, items: list[tuple[int, bytes]]):
        known = _WordHashes()
        self.sets: list[tuple[int, frozenset[bytes]]] = []
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        short: list[tuple[np.ndarray, int]] = []
        for item_id, text in items:
            words = words_of(text)
            found = frozenset(shingles(words))
            if not found:
                continue
            codes = shingle_codes(words, known)
            if len(found) <= SHORT:
                short.append((np.unique(codes), len(self.sets)))
            else:
                signature = ((codes[None, :] ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1)
                rows.setdefault(_size_class(len(found)), []).append((signature, len(self.sets)))
            self.sets.append((item_id, found))
        codes = np.concatenate([c for c, _ in short]) if short else np.zeros(0, np.uint32)
        order = np.argsort(codes, kind="stable")
        self.short_codes, self.short_owners = codes[order], np.repeat([o for _, o in short], [len(c) for c, _ in short])[order] if short else order
        self.steps = sorted(rows)
        #: By step and hash: minima in order, the items behind them, and which upper 16 bits occur.
        self.minima, self.owners, self.seen = {}, {}, {}
        for step, found in rows.items():
            signatures = np.stack([s for s, _ in found], axis=1)
            owners = np.array([o for _, o in found])
            order = np.argsort(signatures, axis=1, kind="stable")
            self.minima[step] = np.take_along_axis(signatures, order, axis=1)
            self.owners[step] = owners[order]
            seen = np.zeros((HASHES, 1 << 16), bool)
            for j in range(HASHES):
                seen[j, signatures[j] >> 16] = True
            self.seen[step] = seen

    def _short_candidates(self, codes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) numbers of the short items that share a code."""
        found: set[tuple[int, int]] = set()
        if not len(self.short_codes) or not codes:
            return found
        flat, docs = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        low = np.searchsorted(self.short_codes, flat, "left")
        hit = self.short_codes[np.minimum(low, len(self.short_codes) - 1)] == flat
        pairs = np.unique(np.c_[docs[hit], low[hit], np.searchsorted(self.short_codes, flat[hit], "right")], axis=0)
        for doc, s, e in pairs.tolist():
            found.update((doc, o) for o in self.short_owners[s:e].tolist())
        return found

    def candidates(self, codes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) numbers whose windows and signatures share a minimum, and those of short items that share a code.

        A document is cut into steps; three steps in a row are a window, half as long again as the largest item of the class, and
        hold every run of that many shingles. The minimum of a longer step is the lesser of two shorter ones.
        """
        found = self._short_candidates(codes)
        if not self.steps:
            return found
        rows = [-(-len(c) // STEP) for c in codes]
        ends = np.cumsum(rows)
        flat = np.full(int(ends[-1]) * STEP, _EMPTY, np.uint32) if len(ends) else np.zeros(0, np.uint32)
        real = np.zeros(len(flat), bool)
        for c, end, n in zip(codes, ends.tolist(), rows):
            flat[(end - n) * STEP: (end - n) * STEP + len(c)] = c
            real[(end - n) * STEP: (end - n) * STEP + len(c)] = True
        by_place = np.ascontiguousarray(flat.reshape(-1, STEP).T)
        missing = np.ascontiguousarray(~real.reshape(-1, STEP).T)
        docs, levels, size = np.repeat(np.arange(len(codes)), rows), [], STEP
        for step in range(self.steps[-1].bit_length() - STEP.bit_length() + 1):
            together = [docs[:-ahead] == docs[ahead:] for ahead in (1, 2)] if size in self.minima else []
            # Steps of a document pair up from its start; an odd one at the end stays alone.
            place = np.arange(len(docs)) - np.searchsorted(docs, docs, side="left")
            head = np.flatnonzero(place % 2 == 0)
            mate = np.minimum(head + 1, len(docs) - 1)
            mate = np.where(docs[mate] == docs[head], mate, head)
            levels.append((size, docs, together, head, mate))
            docs, size = docs[head], size * 2
        for j in range(HASHES):
            hashed = (by_place ^ _MASK[j]) * _ODD[j]
            hashed[missing] = _EMPTY
            least = hashed.min(axis=0)
            for size, docs, together, head, mate in levels:
                if together:
                    window = least.copy()
                    for ahead, same in zip((1, 2), together):
                        if len(least) > ahead:
                            window[:-ahead] = np.where(same, np.minimum(window[:-ahead], least[ahead:]), window[:-ahead])
                    hit = np.flatnonzero(self.seen[size][j][window >> 16])
                    if len(hit):
                        minima, owners, values = self.minima[size][j], self.owners[size][j], window[hit]
                        low, high = np.searchsorted(minima, values, "left"), np.searchsorted(minima, values, "right")
                        for at, s, e in zip(hit[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                            found.update((int(docs[at]), o) for o in owners[s:e].tolist())
                least = np.minimum(least[head], least[mate])
        return found


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size, in the order of their ids."""
    block, size = [], 0
    for row in benchmark.select("item_id", text_bytes()).orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"] or b"")
        block.append((row["item_id"], text))
        size += 1 + len(text.split())
        if size >= BLOCK_SHINGLES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each row of ``docs`` and item with enough of its shingles in it.

    Items of up to SHORT shingles meet every document that shares one of their codes. Larger items go by the class of their size;
    documents are cut into overlapping windows of each class, so that an item fills at least a third of some window that
    holds it and one of HASHES minima agrees with near certainty (a similarity of 0.25 is missed with 1e-6). Each pair that meets is verified on the exact sets of shingles of the whole document. Items are taken in blocks of
    bounded size, each broadcast for one pass over the documents without any shuffle. Items without words match nothing; an
    item of fewer than five words matches documents that consist of it. Null texts are empty; repeated rows give repeated results.
    """
    spark, schema, parts = docs.sparkSession, "doc_id long, item_id long, n_shared long, n_item long, containment double", []
    frame = docs.select("doc_id", text_bytes())

    def pass_over(block):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _WordHashes()
            items = index.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                at = 0
                while at < len(ids):
                    codes, size, start = [], 0, at
                    while at < len(ids) and (size < CHUNK or at == start):
                        codes.append(shingle_codes(words_of(texts[at].as_py()), known))
                        size += len(codes[-1])
                        at += 1
                    out, own, last = [], frozenset(), -1
                    for doc, item in sorted(items.candidates(codes)):
                        if doc != last:
                            own, last = frozenset(shingles(words_of(texts[start + doc].as_py()))), doc
                        item_id, wanted = items.sets[item]
                        shared = len(wanted & own)
                        if shared >= containment * len(wanted):
                            out.append((ids[start + doc], item_id, shared, len(wanted), shared / len(wanted)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) if k > 1 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out))], [
                            "doc_id", "item_id", "n_shared", "n_item", "containment"])

        return map_arrow(frame, rows, schema)

    for block in _item_blocks(benchmark):
        parts.append(pass_over(block))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    name = fresh(docs, "bad_id")
    bad = contained_items(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
