"""Language-model scores by prediction by partial matching over bytes, beside a word-frequency base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from threatloom.llm.common import map_arrow, text_bytes, words_of, written

#: Longest context in bytes.
ORDER = 5
#: Bytes that no UTF-8 text holds: before a text's first byte (context only), and the symbol after its last.
START, END = 0xFE, 0xFF
#: Most gram keys and most words whose values are broadcast; rarer ones are looked up in a join.
HEAD_GRAMS, HEAD_WORDS = 1_000_000, 300_000
#: Positions handled at once, documents turned into Python objects at once, rows of a batch that leaves a task.
CHUNK, DOCS, OUT = 1 << 20, 1_000, 1 << 16


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def gram_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A key for each symbol of each text, its end included: the ``order`` bytes before and the symbol, the symbol lowest;
    and the number of symbols of each text."""
    pad = bytes([START]) * order
    flat = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    keys = np.zeros(max(0, len(flat) - order), np.uint64)
    for back in range(order + 1):
        keys |= flat[order - back: len(flat) - back].astype(np.uint64) << np.uint64(8 * back)
    return keys[flat[order:] != START], np.array([len(t) + 1 for t in texts], np.int64)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


class _Table:
    """Open addressing from 64-bit keys to row numbers, all in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            winners = left[free][first]
            self.rows[at], self.keys[at] = winners, keys[winners]
            left = left[self.rows[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where there is none."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        found = np.where(seen == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.rows[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here, rows = self.keys[slot[open_]], self.rows[slot[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = rows[hit]
            open_ = open_[~hit & (rows >= 0)]
        return found


class Trie:
    """Byte contexts up to ORDER with the counts of the symbols that follow, as code lengths ready to add up.

    A symbol is predicted by the longest context kept. If it never followed there, an escape is paid (method C: as likely as
    the number of distinct symbols seen there against that plus their count) and the context shortened by its first byte,
    where the symbols already refused are excluded. Below the empty context all remaining byte values are equally likely.
    As every symbol of a context also follows each shorter one, what a context excludes is known beforehand: it is kept as
    that context's lower total. ``grams``: by order, (sorted keys, counts). All in memory: the short form of ``gram_values``.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        keys, counts, contexts, own, first_escape, low_total, low_escape, firsts = [], [], [], [], [], [], [], []
        for order, (gram, count) in enumerate(grams):
            tag = np.uint64(order << 56)
            context, start = np.unique(gram >> np.uint64(8), return_index=True)
            n, d = np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64), np.diff(np.r_[start, len(gram)])
            if order:
                lower, lower_count = grams[order - 1]
                above = np.repeat(np.arange(len(context)), d)
                # Counts of this context's symbols in the next shorter context, and that context's total.
                at = np.searchsorted(lower, gram & _mask(order - 1))
                shared = np.bincount(above, lower_count[at], len(context))
                shorter, lower_start = np.unique(lower >> np.uint64(8), return_index=True)
                totals, kinds = np.add.reduceat(lower_count, lower_start), np.diff(np.r_[lower_start, len(lower)])
                which = np.searchsorted(shorter, context & (_mask(order - 2) if order > 1 else np.uint64(0)))
                rest, left = totals[which] - shared, kinds[which] - d
                low_total.append(np.log(np.maximum(rest + left, 1)))
                low_escape.append(np.where(left > 0, np.log(np.maximum(left, 1)) - np.log(np.maximum(rest + left, 1)), 0.0))
            else:
                low_total.append(np.full(len(context), math.log(max(1, 255 - int(d.sum())))))
                low_escape.append(np.zeros(len(context)))
            keys.append(gram | tag)
            counts.append(np.log(count))
            contexts.append(context | tag)
            first_escape.append(np.log(d) - np.log(n + d))
            firsts.append(np.log(count) - np.repeat(np.log(n + d), d))
        self.orders = len(grams)
        # A last entry of zero stands for "none", which has number -1.
        none = [np.zeros(1)]
        self.log_count, self.first, self.first_escape, self.low_total, self.low_escape = (
            np.concatenate(x + none).astype(np.float32) for x in (counts, firsts, first_escape, low_total, low_escape))
        self.gram_keys, self.context_keys = np.concatenate(keys), np.concatenate(contexts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("grams", "contexts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.grams, self.contexts = _Table(self.gram_keys), _Table(self.context_keys)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm for each symbol, given full-length gram keys."""
        total = np.zeros(len(keys), np.float64)
        left = np.arange(len(keys))
        context = np.full(len(keys), -1, np.int32)
        for order in range(self.orders - 1, -1, -1):
            if not len(left):
                break
            tag, gram = np.uint64(order << 56), keys[left] & _mask(order)
            row = self.grams.find(gram | tag)
            hit = row >= 0
            done, rows, over = left[hit], row[hit], context[hit]
            total[done] += np.where(over < 0, self.first[rows], self.log_count[rows] - self.low_total[over])
            left, over = left[~hit], context[~hit]
            here = self.contexts.find((gram[~hit] >> np.uint64(8)) | tag)
            total[left] += np.where(here < 0, 0.0, np.where(over < 0, self.first_escape[here], self.low_escape[over]))
            context = np.where(here < 0, over, here)
        # Below the empty context: any byte value that is not one of its symbols. START is none.
        total[left] -= np.where(context < 0, math.log(255), self.low_total[context])
        return total


class Values:
    """Values of gram keys in one table; for the symbols of texts their sums, and the keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, np.r_[values, 0.0]

    def __getstate__(self):
        return {"keys": self.keys, "values": self.values}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.table = _Table(self.keys)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each text's sum, its end included, and its symbols' keys without a value."""
        out, rare, at = np.zeros(len(texts)), [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < CHUNK or end == at):
                size += len(texts[end])
                end += 1
            keys, lengths = gram_keys(texts[at:end])
            rows = np.concatenate([self.table.find(keys[k: k + CHUNK]) for k in range(0, len(keys), CHUNK)])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            out[at:end] = np.add.reduceat(self.values[rows], starts)
            missing = np.flatnonzero(rows < 0)
            rare += np.split(keys[missing].view(np.int64), np.searchsorted(missing, starts[1:]))
            at = end
        return out, rare


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few documents and, unless one document is longer, some CHUNK bytes of text (their first column)."""
    for batch in batches:
        at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + DOCS, max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def gather(docs: DataFrame) -> DataFrame:
    """(word, gram, n): counts of words, of ends (the empty word) and of gram keys over all rows of ``docs``.

    Each task adds up its share in bounded tables before the shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def flush_words():
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
            words.clear()
            return out

        def flush_grams():
            (keys, counts), = grams
            grams.clear()
            for at in range(0, len(keys), OUT):
                own = keys[at: at + OUT]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.binary()), pa.array(own.view(np.int64)), pa.array(counts[at: at + OUT])], ["word", "gram", "n"])

        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for text in texts:
                words.update(words_of(text))
                if len(words) > 300_000:
                    yield flush_words()
            words[b""] += len(texts)
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (size < CHUNK or end == at):
                    size += len(texts[end])
                    end += 1
                grams.append(np.unique(gram_keys(texts[at:end])[0], return_counts=True))
                at = end
                if len(grams) == 4:
                    grams[:] = [added(*map(np.concatenate, zip(*grams)))]
                    if len(grams[0][0]) > 2_000_000:
                        yield from flush_grams()
        if words:
            yield flush_words()
        if grams:
            grams[:] = [added(*map(np.concatenate, zip(*grams)))]
            yield from flush_grams()

    counted = map_arrow(docs.select(text_bytes()), rows, "word binary, gram long, n long")
    return counted.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least n that at most ``most`` rows reach; counts above 100,000 are one bin."""
    bins = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("rows")).collect()
    total, least = 0, 100_001
    for row in sorted(bins, key=lambda r: -r["n"]):
        total += row["rows"]
        if total > most:
            break
        least = row["n"]
    return least


def _low(column: str, order: int) -> Column:
    """The gram's symbol and the last ``order`` bytes of its context."""
    return F.col(column).bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1))


def trie_tables(grams: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The whole trie of (gram, n) counts, by order: (gram, n), and (context, total, kinds, low_total, low_escape) as in ``Trie``."""
    below, tables = grams, [grams]
    for order in range(ORDER - 1, -1, -1):
        below = written(below.groupBy(_low("gram", order).alias("gram")).agg(F.sum("n").alias("n")), "trie")
        tables.append(below)
    tables.reverse()
    contexts = []
    for order, table in enumerate(tables):
        if not order:
            own = table.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            own = own.withColumn("low_total", F.log(F.greatest(F.lit(1), 255 - F.col("kinds")))).withColumn("low_escape", F.lit(0.0))
        else:
            lower = tables[order - 1].select(F.col("gram").alias("short"), F.col("n").alias("lower"))
            own = table.withColumn("short", _low("gram", order - 1)).join(lower, "short").groupBy(F.shiftright("gram", 8).alias("context")).agg(
                F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("lower").alias("shared"))
            shorter = contexts[-1].select(F.col("context").alias("short"), F.col("total").alias("low_n"), F.col("kinds").alias("low_kinds"))
            own = own.withColumn("short", _low("context", order - 2) if order > 1 else F.lit(0).cast("long")).join(shorter, "short")
            left = F.col("low_kinds") - F.col("kinds")
            rest = F.log(F.greatest(F.lit(1), F.col("low_n") - F.col("shared") + left))
            own = own.select("context", "total", "kinds", rest.alias("low_total"), F.when(left > 0, F.log(left) - rest).otherwise(0.0).alias("low_escape"))
        contexts.append(written(own, "contexts"))
    return tables, contexts


def gram_values(keys: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, times, value) for the distinct ``keys(gram, times)``: the base-10 logarithm that the whole trie of ``grams`` gives each.

    One pass of joins an order; keys that an order has leave, the others take its escape along.
    """
    tables, contexts = trie_tables(grams)
    none = F.lit(None).cast("double")
    open_, done = keys.select("gram", "times", F.lit(0.0).alias("sum"), none.alias("over_total"), none.alias("over_escape")), []
    for order in range(ORDER, -1, -1):
        own, around = tables[order].withColumnRenamed("gram", "key"), contexts[order].withColumnRenamed("context", "around")
        if order < 2:  # at most 65,536 entries
            own, around = F.broadcast(own), F.broadcast(around)
        met = open_.withColumn("key", _low("gram", order)).withColumn("around", F.shiftright("key", 8)).join(own, "key", "left").join(around, "around", "left")
        bottom, first = F.log(F.col("total") + F.col("kinds")), F.col("over_total").isNull()
        hit = F.log("n") - F.when(first, bottom).otherwise(F.col("over_total"))
        escape = F.when(F.col("total").isNull(), 0.0).when(first, F.log("kinds") - bottom).otherwise(F.col("over_escape"))
        met = written(met.select(
            "gram", "times", (F.col("sum") + F.when(F.col("n").isNotNull(), hit).otherwise(escape)).alias("sum"), F.coalesce("low_total", "over_total").alias("over_total"),
            F.when(F.col("total").isNull(), F.col("over_escape")).otherwise(F.col("low_escape")).alias("over_escape"), F.col("n").isNotNull().alias("found")), "order")
        done.append(met.where("found").select("gram", "times", "sum"))
        open_ = met.where("not found").drop("found")
    found = open_.select("gram", "times", (F.col("sum") - F.coalesce("over_total", F.lit(math.log(255)))).alias("sum"))
    for more in done:
        found = found.unionByName(more)
    return found.select("gram", "times", (F.col("sum") / math.log(10)).alias("value"))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    The model learns from the rows that are not held out, its counts cover all of them and all are used. ``score`` is the log10
    probability of the whole text, byte by byte with its end: each distinct gram key of all rows gets its value in joins with the trie;
    the values of the most frequent keys are looked up in the task, the other keys leave it as rows like rare words. The base
    takes lower-cased words and one end a text. Words of the head vocabulary are looked up in the task; others, a few per
    cent, leave it as rows and meet their counts in a join. Null and empty texts have the end alone. Repeated rows are scored
    one by one; a null doc_id is learned from. With nothing to learn from, every byte is equally likely and every word unknown.
    """
    spark = docs.sparkSession
    counts = written(gather(docs.where(~held_out())), "ppm_counts")
    words = counts.where("word is not null").select("word", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, bottom = totals["n"], math.log10(totals["n"] + 0.5 * (totals["v"] + 1))
    least = _least_count(words, HEAD_WORDS)
    head = words.where(F.col("n") >= least).toArrow()
    grams = counts.where("gram is not null").select("gram", "n")
    others = gather(docs.where(held_out())).where("gram is not null").select("gram", "n")
    keys = written(grams.unionByName(others).groupBy("gram").agg(F.sum("n").alias("times")), "gram_keys")
    values = written(gram_values(keys, grams), "gram_values")
    least_gram = _least_count(values.select(F.col("times").alias("n")), HEAD_GRAMS)
    top = values.where(F.col("times") >= least_gram).select("gram", "value").toArrow()
    model = spark.sparkContext.broadcast((
        Values(top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()), head.column(0).to_pylist(), np.log10(head.column(1).to_numpy() + 0.5) - bottom))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, names, values = model.value
        number = {w: k for k, w in enumerate(names)}
        get = number.get
        values = np.r_[values, 0.0]
        end = float(values[get(b"", -1)])
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            n, known, base, rare = [], [], [], []
            for text in texts:
                own = words_of(text)
                found = np.array([get(w, -1) for w in own], np.int64)
                n.append(len(own) + 1)
                known.append(int((found >= 0).sum()) + (b"" in number))
                base.append(float(values[found].sum()) + end)
                rare.append([own[k] for k in np.flatnonzero(found < 0).tolist()] + ([] if b"" in number else [b""]))
            sums, rare_grams = frequent.score(texts)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()),
                pa.array(rare, pa.list_(pa.binary())), pa.array(rare_grams, pa.list_(pa.int64()))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "rare_grams"])

    frame = docs.select(text_bytes(), "doc_id", held_out().alias("held_out"))
    first = written(map_arrow(frame, rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, rare_grams array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "ppm_first")
    rest = first.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    met = rest.join(words.where(F.col("n") < least), "word", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(bottom))).alias("rest"))
    far = first.select("row", F.explode("rare_grams").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times")).join(
        values.where(F.col("times") < least_gram).select("gram", "value"), "gram")
    far_sums = far.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("far"))
    return first.drop("rare", "rare_grams").join(sums, "row", "left").join(far_sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"))
