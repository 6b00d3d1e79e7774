"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threatloom.llm.common import fresh, map_arrow, remove_folder, shared_folder, text_bytes, written

SPACES = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Runs of one level that are merged into one of the next.
FANOUT = 3
#: Stands for a null doc_id: smaller than any other.
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """The line stripped of ASCII white space at both ends, with A-Z in lower case."""
    return line.strip(SPACES).lower()


def _hash_of(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key has fewer than ``least`` code points."""
    if len(line) < least:
        return None
    key = line_key(line)
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(high, low, doc_id): the distinct hashes of each document's long keys. A null doc_id becomes NO_ID."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for line in (text or b"").split(b"\n") if (h := _hash_of(line, least_chars))}
                hashes += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
            halves = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pa.py_buffer(b"".join(hashes))]).to_numpy().reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["high", "low", "doc_id"])

    return map_arrow(docs.select("doc_id", text_bytes()), rows, "high long, low long, doc_id long")


class LineRuns:
    """Sorted runs (high, low, n_docs, last_doc) in levels, as Parquet in the shared folder.

    A new batch is merge-joined with the runs to see which of its lines are known, then adds a run of its own at level 0.
    FANOUT runs of a level are merged into one run of the next, so n batches leave about FANOUT * log n runs and each
    hash is rewritten once a level. The driver holds the paths of the runs only.
    """

    def __init__(self, spark, name: str = "line_runs"):
        self.spark, self.name, self.levels = spark, name, [[]]

    SCHEMA = "high long, low long, n_docs long, last_doc long"

    def _write(self, rows: DataFrame) -> str:
        path = shared_folder(self.spark, self.name)
        rows.sortWithinPartitions("high", "low").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def totals(self) -> DataFrame:
        """One row per hash over all batches so far."""
        return self._merged(self._read([p for level in self.levels for p in level]))

    def absorb(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (high, low, doc_id); returns its rows that repeat a line of the runs or of a larger doc_id of the batch."""
        lines = written(lines.distinct(), f"{self.name}_batch")
        own = lines.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = self._read([p for level in self.levels for p in level]).select("high", "low").distinct().withColumn("known", F.lit(True))
        path = self._write(own)
        newest = self._read([path]).select("high", "low", "last_doc")
        repeats = lines.join(newest, ["high", "low"]).join(known, ["high", "low"], "left").where("known or doc_id < last_doc").select("high", "low", "doc_id")
        repeats = written(repeats, f"{self.name}_repeats")
        self.levels[0].append(path)
        self._compact()
        return repeats

    def _compact(self) -> None:
        for level, paths in enumerate(self.levels):
            if len(paths) >= FANOUT:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merged(self._read(paths))))
                self.levels[level] = []
                for path in paths:
                    remove_folder(self.spark, path)


def batches_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Ranges of doc_id, the largest first, so that a line's first holder is its largest; null ids come last."""
    cuts = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    ranges = [F.col("doc_id") >= cuts[0]] if cuts else []
    ranges += [(F.col("doc_id") >= low) & (F.col("doc_id") < high) for high, low in zip(cuts, cuts[1:])]
    ranges.append((F.col("doc_id") < cuts[-1]) | F.col("doc_id").isNull() if cuts else F.lit(True))
    return [docs.where(r) for r in ranges]


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` freed of common lines, and ``n_lines`` (before), ``n_dropped``, both long.

    A line whose key has at least ``least_chars`` code points and is found in at least ``least_docs`` documents stays only in the
    largest doc_id that holds it, there with all its copies. The batches arrive with the largest ids first; each is joined
    with the runs of those before. Null and empty texts are one empty line, and give an empty text. Rows that share a doc_id
    are one document; rows without one count together as one document, smaller than all. Other columns pass through.
    """
    runs = LineRuns(docs.sparkSession)
    repeats = [runs.absorb(line_hashes(batch, least_chars)) for batch in batches_by_id(docs, batches)]
    common = runs.totals().where(F.col("n_docs") >= least_docs).select("high", "low")
    every = repeats[0]
    for more in repeats[1:]:
        every = every.unionByName(more)
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    key, gone_from = fresh(docs, "dedup_id"), fresh(docs, "dedup_lines")
    dropped = every.join(common, ["high", "low"], "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias(gone_from)).withColumnRenamed("doc_id", key)
    frame = docs.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).join(dropped, key, "left").select(*names, text_bytes(), gone_from)
    passed = docs.select(*names).schema
    schema = docs.select(*names).schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            drops = batch.column(len(passed) + 1).to_pylist()
            for text, drop in zip(batch.column(len(passed)).to_pylist(), drops):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    bad = {pa.array([d["high"], d["low"]], pa.int64()).buffers()[1].to_pybytes()[:16] for d in drop}
                    kept = [line for line in lines if _hash_of(line, least_chars) not in bad]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(passed)], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                [*names, "text", "n_lines", "n_dropped"])

    return map_arrow(frame, rows, schema)
