"""Ranked lexical search: term at a time over document shards, with a limit on accumulators that loses no result."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threatloom.llm.common import map_arrow, shared_folder, text_bytes, written

#: Results of an item.
TOP = 50
#: Terms of the items of one block: what is broadcast stays below some 20 MB whatever the benchmark.
BLOCK_TERMS = 200_000
#: Postings and documents held by a task before its shard is searched.
SHARD_POSTINGS, SHARD_DOCUMENTS = 2_000_000, 1 << 16
#: Distinct terms counted in a task before they go on.
COUNTED_TERMS = 500_000

#: Everything but ASCII digits, letters and the bytes of other characters becomes a space; A-Z become lower case.
_FOLD = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, n): documents that hold each term; the row of the empty term has N and L. Counted by batch, then summed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: Counter[bytes] = Counter()
        documents = total = 0

        def flush():
            found = pa.RecordBatch.from_arrays(
                [pa.array([b"", *holders], pa.binary()), pa.array([documents, *holders.values()], pa.int64()), pa.array([total] + [0] * len(holders), pa.int64())],
                ["term", "df", "n"])
            holders.clear()
            return found

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                documents += bool(words)
                total += len(words)
                holders.update(set(words))
                if len(holders) > COUNTED_TERMS:
                    yield flush()
                    documents = total = 0
        yield flush()

    counted = map_arrow(docs.select(text_bytes()), rows, "term binary, df long, n long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the terms of each item once; rows that share an item_id are one item, a null one included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], batch.schema.field(0).type), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    frame = items.select("item_id", text_bytes())
    return map_arrow(frame, rows, f"item_id {frame.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Block:
    """The number of each term and its weight; ids of items and their terms' numbers, heaviest (rarest) first."""

    numbers: dict[bytes, int]
    weights: np.ndarray
    names: list
    items: list[np.ndarray]


def make_block(rows: list[tuple[object, bytes, int]], documents: int) -> Block:
    """From (item_id, term, df)."""
    numbers: dict[bytes, int] = {}
    weights: list[int] = []
    items: dict[object, list[int]] = {}
    for item, term, df in rows:
        if term not in numbers:
            numbers[term] = len(weights)
            weights.append(weight(documents, df))
        items.setdefault(item, []).append(numbers[term])
    w = np.array(weights, np.int64)
    return Block(numbers, w, list(items), [np.array(sorted(x, key=lambda t: (-w[t], t)), np.int64) for x in items.values()])


def search(order: np.ndarray, starts: np.ndarray, docs: np.ndarray, gains: np.ndarray, most: np.ndarray, size: int, floor: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard (numbers below ``size``) that may be among the ``top`` of an item, and their exact scores.

    ``order``: the item's terms, rarest first. Postings of term t: docs[starts[t]:starts[t+1]] (ascending) with the points gained there;
    most[t] is the largest of them. ``floor``: a score that ``top`` documents seen elsewhere reach. A document without an accumulator
    can reach the remaining bounds at most: once these are below the kth partial score (or the floor), no accumulator is made any more
    and only those that can still reach it are updated. A tie with the kth score still counts, as the smaller doc_id wins it.
    """
    order = order[starts[order + 1] > starts[order]]
    bounds = np.r_[np.cumsum(most[order][::-1])[::-1], 0]
    scores = np.zeros(size, np.int64)
    best = 0
    for at, term in enumerate(order.tolist()):
        # Scores only rise, so the kth score now is a bound of the kth score in the end.
        if bounds[at] <= max(best, floor):
            kth = floor
            if np.count_nonzero(scores) >= top:
                kth = max(kth, int(np.partition(scores, size - top)[size - top]))
            if bounds[at] < kth:
                break
        s, e = starts[term], starts[term + 1]
        scores[docs[s:e]] += gains[s:e]
        best = max(best, int(scores[docs[s:e]].max()))
    else:
        found = np.flatnonzero(scores)
        return found, scores[found]
    # Accumulators are limited from here on.
    alive = np.flatnonzero(scores + bounds[at] >= kth)
    alive = alive[scores[alive] > 0]
    kept = scores[alive]
    for at in range(at, len(order)):
        term = order[at]
        own, gained = docs[starts[term]: starts[term + 1]], gains[starts[term]: starts[term + 1]]
        place = np.minimum(np.searchsorted(own, alive), len(own) - 1)
        kept = kept + np.where(own[place] == alive, gained[place], 0)
        if len(alive) > top:
            kth = max(kth, int(np.partition(kept, len(kept) - top)[len(kept) - top]))
            stay = kept + bounds[at + 1] >= kth
            alive, kept = alive[stay], kept[stay]
    return alive, kept


class _Best:
    """The best documents of every item that a task has seen: by score, then by id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.found = top, [[] for _ in range(items)]

    def floor(self, item: int) -> int:
        found = self.found[item]
        return found[-1][0] if len(found) >= self.top else 1

    def add(self, item: int, rows: list[tuple[int, int | None]]) -> None:
        self.found[item] = sorted(self.found[item] + rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.top]


def _shard_search(block: Block, best: _Best, ids: list, terms: list[np.ndarray], counts: list[np.ndarray], lengths: list[int], documents: int, total: int) -> None:
    """Search every item of the block in one shard and keep its best documents."""
    if not ids:
        return
    sizes = np.array([len(t) for t in terms])
    flat, tf = np.concatenate(terms), np.concatenate(counts)
    owner = np.repeat(np.arange(len(ids)), sizes)
    m = np.array([50 + 50 * n * documents // total for n in lengths], np.int64)
    gains = block.weights[flat] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
    order = np.argsort(flat, kind="stable")
    docs, gains = owner[order], gains[order]
    starts = np.searchsorted(flat[order], np.arange(len(block.weights) + 1))
    most = np.zeros(len(block.weights), np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    most[full] = np.maximum.reduceat(gains, starts[full]) if len(full) else 0
    for item, own in enumerate(block.items):
        found, scores = search(own, starts, docs, gains, most, len(ids), best.floor(item), best.top)
        if len(scores) > best.top:
            stay = scores >= np.partition(scores, len(scores) - best.top)[len(scores) - best.top]
            found, scores = found[stay], scores[stay]
        rows = [(s, ids[d]) for d, s in zip(found.tolist(), scores.tolist()) if s > 0]
        if rows:
            best.add(item, rows)


def _blocks(weighed: DataFrame, documents: int) -> Iterator[Block]:
    """Blocks of whole items with some BLOCK_TERMS terms."""
    rows: list[tuple[object, bytes, int]] = []
    for row in weighed.orderBy("item_id").select("item_id", "term", "df").toLocalIterator():
        if len(rows) >= BLOCK_TERMS and row["item_id"] != rows[-1][0]:
            yield make_block(rows, documents)
            rows = []
        rows.append((row["item_id"], bytes(row["term"]), row["df"]))
    if rows:
        yield make_block(rows, documents)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by ascending doc_id.

    One pass over ``docs`` counts terms. Each block of items (bounded, one at a time) is then sent to the documents: a task indexes
    its documents by the block's terms, shard by shard, and searches each item term at a time, starting from the kth score it has
    already seen. No postings are shuffled; a task returns ``top`` rows an item at most, which one window ranks.
    Every row of ``docs`` is a document, repeated rows too; a null doc_id loses ties. Null and empty texts have no terms and count
    nowhere; items without terms, or whose terms no document has, get no row. Other columns are not read.
    """
    spark = docs.sparkSession
    item_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    schema = f"item_id {item_type}, doc_id {doc_type}, score long"
    wanted = written(item_terms(items), "item_terms")
    needed = wanted.select("term").unionByName(spark.range(1).select(F.lit("").cast("binary").alias("term"))).distinct()
    known = written(term_counts(docs).join(needed, "term", "left_semi"), "terms")
    (whole,) = known.where(F.octet_length("term") == 0).collect()
    documents, total = whole["df"], whole["n"]
    weighed = wanted.join(known.select("term", "df"), "term")
    frame, path = docs.select("doc_id", text_bytes()), shared_folder(spark, "ranked")
    kinds = [to_arrow_type(t) for t in (items.schema["item_id"].dataType, docs.schema["doc_id"].dataType)] + [pa.int64()]

    def pass_over(block: Block) -> None:
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            numbers, best = block.numbers, _Best(len(block.items), top)
            ids, terms, counts, lengths, held = [], [], [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = terms_of(text.as_py())
                    tf = Counter(words)
                    own = [(numbers[t], c) for t, c in tf.items() if t in numbers]
                    if not own:
                        continue
                    pairs = np.array(own, np.int64)
                    ids.append(doc_id)
                    terms.append(pairs[:, 0])
                    counts.append(pairs[:, 1])
                    lengths.append(len(words))
                    held += len(own)
                    if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCUMENTS:
                        _shard_search(block, best, ids, terms, counts, lengths, documents, total)
                        ids, terms, counts, lengths, held = [], [], [], [], 0
            _shard_search(block, best, ids, terms, counts, lengths, documents, total)
            for at in range(0, len(best.found), 1000):
                out = [(name, doc_id, score) for name, found in zip(block.names[at: at + 1000], best.found[at: at + 1000]) for score, doc_id in found]
                if out:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

        map_arrow(frame, rows, schema).write.mode("append").parquet(path)
        sent.destroy()

    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(weighed, documents):
        pass_over(block)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
