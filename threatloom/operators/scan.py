"""Ordered scans that survive a hot key.

A window partitioned by a hot key puts all its rows in one task. These scans
cut every key into time chunks, scan inside a chunk, scan the one-row-per-chunk
totals per key, and add the two. A key's level-two partition has at most
(period / chunk) rows whatever the volume; the row-level partitions hold one
chunk of one key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

BEFORE = (W.unboundedPreceding, -1)
UP_TO = (W.unboundedPreceding, W.currentRow)


def chunk_of(position: str, width: int) -> Column:
    return F.expr(f"`{position}` div {int(width)}")


def running_sums(rows: DataFrame, keys: Sequence[str], position: str, order: Sequence[str],
                 sums: dict[str, str], chunk: int) -> DataFrame:
    """Inclusive running sums per key: ``sums`` maps new column -> summed column.

    ``position`` is the leading numeric order column that is cut into chunks of
    ``chunk``; ``order`` is the full order and starts with ``position``.
    """
    keys = list(keys)
    rows = rows.withColumn("_chunk", chunk_of(position, chunk))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*UP_TO)
    scanned = rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(*BEFORE) if keys else \
        W.orderBy("_chunk").rowsBetween(*BEFORE)
    carried = (
        rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
        .select(*keys, "_chunk", *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_pre_{o}") for o in sums])
    )
    joined = scanned.join(carried, [*keys, "_chunk"])
    for out in sums:
        joined = joined.withColumn(out, (F.col(f"_in_{out}") + F.col(f"_pre_{out}")).cast("long"))
    return joined.drop("_chunk", *[f"_in_{o}" for o in sums], *[f"_pre_{o}" for o in sums])


def lag_by_chunk(rows: DataFrame, order: str, columns: Sequence[str], chunk: int) -> DataFrame:
    """Previous row's ``columns`` (as ``prev_<name>``) in one global order.

    Inside a chunk this is a plain lag; only each chunk's last row crosses the
    border, so the unpartitioned step sees one row per chunk.
    """
    rows = rows.withColumn("_chunk", chunk_of(order, chunk))
    packed = F.struct(*columns)
    inside = W.partitionBy("_chunk").orderBy(order)
    scanned = rows.withColumn("_prev", F.lag(packed).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = rows.groupBy("_chunk").agg(F.max_by(packed, F.col(order)).alias("_last"))
    border = last.select("_chunk", F.lag("_last").over(W.orderBy("_chunk")).alias("_border"))
    joined = scanned.join(border, "_chunk", "left")
    prev = F.when(F.col("_first"), F.col("_border")).otherwise(F.col("_prev"))
    return joined.select(*[c for c in rows.columns if c != "_chunk"], *[prev[c].alias(f"prev_{c}") for c in columns])


def hop(times: np.ndarray, anchor: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Greedy anchors in sorted ``times``: the next is the first time > anchor + ttl."""
    picked: list[int] = []
    at = 0 if anchor is None else int(np.searchsorted(times, anchor + ttl, side="right"))
    while at < len(times):
        picked.append(at)
        anchor = int(times[at])
        at = int(np.searchsorted(times, anchor + ttl, side="right"))
    return picked, anchor


def key_segments(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[int, int, tuple]]:
    """Runs of equal keys in a key-sorted batch."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for key in keys:
        values = pdf[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(changed)
    ends = np.append(starts[1:], len(pdf))
    columns = [pdf[key].to_numpy() for key in keys]
    for lo, hi in zip(starts, ends):
        yield int(lo), int(hi), tuple(c[lo] for c in columns)


def key_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of a key in one task, in order, for a fold with constant memory.

    Callers reduce to one row per (key, second) first, which bounds a key's
    rows by the seconds of the period.
    """
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


def anchored_windows(points: DataFrame, keys: Sequence[str], at: str, ttl: int) -> DataFrame:
    """Rows that start a window: first per key, then the first later than anchor + ttl.

    ``points`` holds one row per (keys, at). Repeats never extend a window, so
    this is not a session window. The fold walks sorted batches and keeps one
    number per key, whatever the key's length.
    """
    keys = list(keys)
    points = points.select(*keys, at, *[c for c in points.columns if c not in (*keys, at)])

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            times = pdf[at].to_numpy()
            keep: list[int] = []
            for lo, hi, key in key_segments(pdf, keys):
                if key != current:
                    current, anchor = key, None
                picked, anchor = hop(times[lo:hi], anchor, ttl)
                keep.extend(lo + i for i in picked)
            yield pdf.iloc[keep]

    return key_sorted(points, keys, [at]).mapInPandas(walk, T.StructType(points.schema.fields))


def within_windows(rows: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, start: str, span: int) -> DataFrame:
    """Rows with ``start <= at <= start + span``, as an equi-join on time cells.

    A window reaches at most two cells of ``span + 1`` seconds, so the window
    side grows by two and a hot key spreads over its cells.
    """
    width = span + 1
    cells = windows.withColumn(
        "_cell", F.explode(F.array_distinct(F.array(chunk_of(start, width), F.expr(f"(`{start}` + {span}) div {width}")))))
    return (
        rows.withColumn("_cell", chunk_of(at, width)).join(cells, [*keys, "_cell"])
        .where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + span)).drop("_cell")
    )


def presence_edges(sightings: DataFrame, keys: Sequence[str], item: str, at: str, window: int) -> DataFrame:
    """Net change of the number of present items per (keys, at).

    An item is present from a sighting until ``window`` later; overlapping
    presences of one item count once. ``sightings`` holds one row per
    (keys, item, at). A running sum of ``step`` is the distinct count of items
    seen in the trailing window.
    """
    by_item = W.partitionBy(*keys, item).orderBy(at)
    arrives = F.coalesce(F.col(at) - F.lag(at).over(by_item) > window, F.lit(True))
    leaves = F.coalesce(F.lead(at).over(by_item) - F.col(at) > window, F.lit(True))
    edge = lambda when, step: F.struct(when.cast("long").alias("at"), F.lit(step).alias("step"))
    return (
        sightings.withColumn("_arrives", arrives).withColumn("_leaves", leaves)
        .select(*keys, F.explode(F.array_compact(F.array(
            F.when(F.col("_arrives"), edge(F.col(at), 1)), F.when(F.col("_leaves"), edge(F.col(at) + window + 1, -1))))).alias("e"))
        .groupBy(*keys, F.col("e.at").alias(at)).agg(F.sum("e.step").alias("step")))


def counts_within(events: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, counted: dict[str, str], chunk: int) -> DataFrame:
    """Add sums of ``counted`` over events of the interval's key with ``start <= at < end``.

    Each interval asks for two running sums instead of meeting every event it
    spans, so long intervals over a busy key cost two rows. A null end is open.
    ``intervals`` needs a unique ``interval_id``.
    """
    sums = events.groupBy(key, at).agg(*[F.sum(c).alias(o) for o, c in counted.items()])
    far = F.lit(1 << 62)
    bounds = intervals.select(key, "interval_id", F.explode(F.array(
        F.struct(F.col(start).cast("long").alias("at"), F.lit(-1).alias("sign")),
        F.struct(F.coalesce(F.col(end).cast("long"), far).alias("at"), F.lit(1).alias("sign")))).alias("b"))
    points = bounds.select(key, "interval_id", F.col("b.at").alias(at), F.col("b.sign").alias("sign"), *[F.lit(0).cast("long").alias(o) for o in counted])
    marks = sums.select(key, F.lit(None).cast(bounds.schema["interval_id"].dataType).alias("interval_id"), at, F.lit(None).cast("int").alias("sign"), *counted)
    both = points.unionByName(marks).withColumn("_mark", F.col("interval_id").isNull())
    # Boundaries come before events of the same instant: the start is included, the end is not.
    ran = running_sums(both, [key], at, [at, "_mark", "interval_id", "sign"], {f"_run_{o}": o for o in counted}, chunk)
    totals = ran.where("not _mark").groupBy("interval_id").agg(*[F.sum(F.col("sign") * F.col(f"_run_{o}")).alias(o) for o in counted])
    return intervals.join(totals, "interval_id", "left")
