"""The eight behavioural detectors.

Every detector takes a frame and returns one row per detection. Events of one
key are ordered by ``(epoch_s, event_id)``. Each frame is reduced before it is
shuffled: to one row per (key, second) where the signal allows it, to flags and
counts otherwise, so that a key holding a large share of the rows is spread
over time chunks (see ``scan``).

Frames
    contacts / dns queries: event_id, src, dst, [qtype], ts_iso, epoch_s
    dns answers:            event_id, domain, answer, ttl, ts_iso, epoch_s
    flows:                  event_id, host, dst, out_bytes, in_bytes, ts_iso, epoch_s
    tls:                    event_id, client, dst, sni, cert_covers_sni,
                            is_ip_https, has_sni, ts_iso, epoch_s
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from threatloom.functions import text
from threatloom.functions.instants import iso_of_epoch, times_agree
from threatloom.operators import scan
from threatloom.session import cut_lineage

# Evidence kinds, family names and default thresholds.
FAMILIES = (
    "beacon_periodicity", "dga_likelihood", "dns_tunneling", "fastflux",
    "volume_anomaly", "first_seen_novelty", "tls_metadata_mismatch", "sync_first_contact",
)
BEHAVIORAL_PREFIX = "behavioral_"
LOCAL_SOURCE = "local-behavioral"
DATA_QUERY_TYPES = ("TXT", "MX", "NULL", "ANY", "CH", "HINFO", "CNAME", "SRV", "TLSA")
DAY_S = 86_400


def agreeing(frame: DataFrame) -> DataFrame:
    """Drop events whose text and numeric instants contradict each other."""
    return frame.where(times_agree(F.col("ts_iso"), F.col("epoch_s")))


def _first_per_second(frame: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """One row per (keys, second), carrying the earliest event's columns."""
    first = F.min(F.struct("event_id", *carried)).alias("_first")
    return frame.groupBy(*keys, "epoch_s").agg(first).select(*keys, "epoch_s", *[f"_first.{c}" for c in carried])


# --- BD-1 beacon periodicity -------------------------------------------------

def beacon_periodicity(contacts: DataFrame, min_events: int = 6, tolerance_micros: int = 250_000,
                       min_median_s: int = 10, max_median_s: int = 3600) -> DataFrame:
    """Pairs whose last ``min_events + 64`` gaps all lie near their median.

    Repeats inside a second are not gaps, so a pair is reduced to its distinct
    seconds. A detection needs ``min_events`` gaps since the previous one.
    """
    pair = ["src", "dst"]
    seconds = _first_per_second(contacts, pair, ["ts_iso"])
    by_pair = W.partitionBy(*pair).orderBy("epoch_s")
    kept = min_events + 64
    frame = by_pair.rowsBetween(-(kept - 1), 0)
    gaps = (
        seconds
        .withColumn("gap", F.col("epoch_s") - F.lag("epoch_s").over(by_pair))
        .withColumn("first_seen", F.first("ts_iso").over(by_pair.rowsBetween(*scan.UP_TO)))
        .where("gap is not null")
        .withColumn("gap_no", F.row_number().over(by_pair).cast("long"))
        .withColumn("_low", F.min("gap").over(frame))
        .withColumn("_high", F.max("gap").over(frame))
        .withColumn("_gaps", F.collect_list("gap").over(frame))
        # Every median lies between the extremes, so most rows fail here without a sort.
        .where(f"gap_no >= {min_events} and _high >= {min_median_s} and _low <= {max_median_s} "
               f"and _high * {1_000_000 - tolerance_micros - 1} <= _low * {1_000_000 + tolerance_micros + 1}")
        .withColumn("_sorted", F.sort_array("_gaps"))
        .withColumn("events", F.size("_sorted").cast("long"))
        .withColumn("median_gap_s", F.expr(
            "case when events % 2 = 1 then _sorted[cast(events div 2 as int)] "
            "else (_sorted[cast(events div 2 as int) - 1] + _sorted[cast(events div 2 as int)]) div 2 end"))
    )
    steady = gaps.where(
        f"median_gap_s between {min_median_s} and {max_median_s} "
        f"and ((_high - median_gap_s) * 1000000) div median_gap_s <= {tolerance_micros} "
        f"and ((median_gap_s - _low) * 1000000) div median_gap_s <= {tolerance_micros}"
    ).select(*pair, "gap_no", "epoch_s", "ts_iso", "first_seen", "events", "median_gap_s")
    spaced = scan.anchored_windows(steady, pair, "gap_no", min_events - 1)
    return spaced.select(*pair, "epoch_s", F.col("ts_iso").alias("observed_at"), "first_seen", "events", "median_gap_s")


# --- BD-2 generated-name structure -------------------------------------------

def dga_likelihood(queries: DataFrame, ttl_s: int = DAY_S, high_microbits: int = 2_850_000,
                   medium_microbits: int = 2_400_000) -> DataFrame:
    """First-seen names whose leftmost label looks generated. Low bands use up the first sighting."""
    named = queries.withColumn("dst", text.strip_dots(F.col("dst"))).where("dst <> ''")
    first = scan.anchored_windows(_first_per_second(named, ["dst"], ["src", "ts_iso"]), ["dst"], "epoch_s", ttl_s)
    return generated_names(first, high_microbits, medium_microbits)


def generated_names(first: DataFrame, high_microbits: int = 2_850_000, medium_microbits: int = 2_400_000) -> DataFrame:
    """First sightings (src, dst, epoch_s, ts_iso) whose leftmost label is in a high or medium band."""
    label = text.leftmost_label(F.col("dst"))
    return (
        first
        .withColumn("entropy_microbits", text.entropy_microbits(label))
        .where(F.col("entropy_microbits") >= medium_microbits)
        .withColumn("band", F.when(F.col("entropy_microbits") >= high_microbits, "high").otherwise("medium"))
        .select("src", "dst", "epoch_s", F.col("ts_iso").alias("observed_at"), "band", "entropy_microbits",
                F.length(label).cast("long").alias("label_len"), text.label_depth(F.col("dst")).alias("label_depth"))
    )


# --- BD-3 DNS tunnelling -----------------------------------------------------

def label_signals(queries: DataFrame, label_len: int = 24, high_microbits: int = 3_100_000) -> DataFrame:
    """(src, event_id, epoch_s, ts_iso, chars, long_label, data_type) of each query. Only labels that are long enough are measured."""
    label = text.leftmost_label(text.strip_dots(F.col("dst")))
    qtype = F.upper(F.coalesce(F.when(F.col("qtype") != "", F.col("qtype")), F.lit("A")))
    suspicious = F.when(F.length(label) >= label_len, text.entropy_microbits(label) >= high_microbits)
    return queries.select(
        "src", "event_id", "epoch_s", "ts_iso", F.length(label).cast("long").alias("chars"),
        F.coalesce(suspicious, F.lit(False)).alias("long_label"), qtype.isin(*DATA_QUERY_TYPES).alias("data_type"))


def dns_tunneling(queries: DataFrame, window_queries: int = 200, min_queries: int = 40, label_len: int = 24,
                  high_microbits: int = 3_100_000, min_share_micros: int = 350_000, min_avg_chars: int = 60,
                  idle_s: int = 3600, chunk_s: int = 60) -> DataFrame:
    """Clients whose current block of queries carries long, near-uniform labels.

    Blocks of ``window_queries`` restart after ``idle_s`` of silence; the query
    that completes a block never reports. ``chunk_s`` must not exceed
    ``idle_s``: then silence can only fall between chunks, sessions and row
    numbers come from per-chunk counts, and a block is at most
    ``window_queries`` rows whatever the client's volume.
    """
    if chunk_s > idle_s:
        raise ValueError("chunk_s must not exceed idle_s")
    rows = label_signals(queries, label_len, high_microbits).withColumn("chunk", scan.chunk_of("epoch_s", chunk_s))
    by_client = W.partitionBy("src").orderBy("chunk")
    chunks = (
        rows.groupBy("src", "chunk").agg(F.count("*").alias("n"), F.min("epoch_s").alias("lo"), F.max("epoch_s").alias("hi"))
        .withColumn("session", F.sum(F.when(F.col("lo") - F.lag("hi").over(by_client) > idle_s, 1).otherwise(0))
                    .over(by_client.rowsBetween(*scan.UP_TO)))
        .withColumn("before", F.coalesce(F.sum("n").over(
            W.partitionBy("src", "session").orderBy("chunk").rowsBetween(*scan.BEFORE)), F.lit(0)))
        .select("src", "chunk", "session", "before")
    )
    in_chunk = W.partitionBy("src", "chunk").orderBy("epoch_s", "event_id")
    numbered = (
        rows.withColumn("_rn", F.row_number().over(in_chunk)).join(chunks, ["src", "chunk"])
        .withColumn("_at", F.col("before") + F.col("_rn") - 1)
        .withColumn("block", F.expr(f"_at div {window_queries}"))
        .withColumn("queries", F.expr(f"_at % {window_queries} + 1").cast("long"))
    )
    in_block = W.partitionBy("src", "session", "block").orderBy("queries").rowsBetween(*scan.UP_TO)
    return (
        numbered
        .withColumn("_long", F.sum(F.col("long_label").cast("long")).over(in_block))
        .withColumn("chars_sum", F.sum("chars").over(in_block))
        .withColumn("data_type_queries", F.sum((F.col("long_label") & F.col("data_type")).cast("long")).over(in_block))
        .withColumn("share_micros", F.expr("_long * 1000000 div queries"))
        .withColumn("avg_label_chars", F.expr("chars_sum div queries"))
        .where((F.col("queries") >= min_queries) & (F.col("queries") < window_queries)
               & (F.col("share_micros") >= min_share_micros) & (F.col("avg_label_chars") >= min_avg_chars))
        .select("src", "event_id", "epoch_s", F.col("ts_iso").alias("observed_at"), "queries", "share_micros",
                "avg_label_chars", "data_type_queries")
    )


# --- BD-4 answer churn -------------------------------------------------------

def _retained_heads(seconds: DataFrame, ttl_s: int, keep: int, min_distinct: int) -> DataFrame:
    """Per (domain, second) by whose end enough answers are known: totals before it and the retained list's head after each of its rows.

    The retained list is cut to its last ``keep`` rows whenever its head is
    older than ``ttl_s``. Inside one second the head settles within ``keep``
    rows, so that many heads describe the whole second.
    """
    schema = ("domain string, epoch_s long, before long, ttl_before long, distinct_before long, "
              "heads array<long>, heads_at array<long>")
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        count = head = head_at = ttl_sum = distinct = 0
        recent: deque[int] = deque(maxlen=keep)
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            columns = (pdf["domain"], *(pdf[c].tolist() for c in ("epoch_s", "n", "ttl", "new_answers")))
            for domain, at, n, ttl, new in zip(*columns):
                if domain != current:
                    current, count, head, head_at, ttl_sum, distinct = domain, 0, 1, at, 0, 0
                    recent = deque(maxlen=keep)
                before, heads, heads_at = count, [], []
                for _ in range(min(n, keep)):
                    count += 1
                    recent.append(at)
                    if at - head_at > ttl_s:
                        moved = max(head, count - keep + 1)
                        head_at = recent[moved - count - 1] if moved != head else head_at
                        head = moved
                    heads.append(head)
                    heads_at.append(head_at)
                if n > keep:
                    count += n - keep
                    recent.extend([at] * keep)
                if distinct + new >= min_distinct:
                    out.append((domain, at, before, ttl_sum, distinct, heads, heads_at))
                ttl_sum += ttl
                distinct += new
            yield pd.DataFrame(out, columns=names)

    ordered = scan.key_sorted(seconds.select("domain", "epoch_s", "n", "ttl", "new_answers"), ["domain"], ["epoch_s"])
    return ordered.mapInPandas(walk, schema)


def fastflux_retained(answers: DataFrame, min_distinct: int = 5, min_answers: int = 8, ttl_s: int = DAY_S,
                      keep: int = 8) -> DataFrame:
    """Domains churning through addresses; distinct answers and TTL sums never expire.

    ``events`` is the length of a retained list that is cut to its last
    ``keep`` answers once its head is older than ``ttl_s``. One row per answer.
    Whole seconds are folded in order; rows are only ordered inside a second.
    First sightings stand before their answers as rows of their own, so no row is
    shuffled to meet them.
    """
    order = ["event_id", "answer", "_row"]
    # The same filters and columns for every use of the rows, so that Spark shuffles the answers once for all of them.
    rows = answers.withColumn("domain", text.strip_dots(F.col("domain"))).where("domain <> '' and epoch_s is not null") \
        .select("domain", "answer", F.col("ttl").cast("long").alias("ttl"), "ts_iso", "epoch_s", "event_id")
    firsts = rows.groupBy("domain", "answer").agg(F.min(F.struct("epoch_s", "event_id", "ttl")).alias("f"))
    # A null is no answer: its sighting counts neither as a row nor as new.
    marked = rows.withColumn("_row", F.lit(1)).unionByName(
        firsts.select("domain", "answer", "f.epoch_s", "f.event_id", F.when(F.col("answer").isNotNull(), 0).alias("_row")), allowMissingColumns=True)
    n, new_answers = F.sum("_row"), F.sum(1 - F.col("_row"))
    seconds = marked.groupBy("domain", "epoch_s").agg(n.alias("n"), F.sum("ttl").alias("ttl"), new_answers.alias("new_answers"))
    so_far = W.partitionBy("domain", "epoch_s").orderBy(*order).rowsBetween(*scan.UP_TO)
    return (
        marked
        .withColumn("_rn", n.over(so_far))
        .withColumn("_ttl", F.sum("ttl").over(so_far))
        .withColumn("_distinct", new_answers.over(so_far))
        .where("_row = 1")
        .join(_retained_heads(seconds, ttl_s, keep, min_distinct), ["domain", "epoch_s"])
        .withColumn("_slot", F.least(F.col("_rn"), F.size("heads")).cast("int"))
        .withColumn("events", F.col("before") + F.col("_rn") - F.element_at("heads", F.col("_slot")) + 1)
        .withColumn("distinct_answers", F.col("distinct_before") + F.col("_distinct"))
        .where((F.col("events") >= min_answers) & (F.col("distinct_answers") >= min_distinct))
        .select(F.col("domain").alias("dst"), "event_id", "answer", "epoch_s", F.col("ts_iso").alias("observed_at"),
                iso_of_epoch(F.element_at("heads_at", F.col("_slot"))).alias("first_seen"), "events", "distinct_answers",
                F.expr("(ttl_before + _ttl) div events").alias("avg_ttl"))
    )


def fastflux_windowed(answers: DataFrame, min_distinct: int = 5, min_answers: int = 8, window_s: int = DAY_S) -> DataFrame:
    """Domains with enough answers and distinct addresses in the trailing window.

    Evaluated once per (domain, second). An address is present from a sighting
    until ``window_s`` later, so distinct counts are a running sum of arrivals
    and departures of merged presence intervals.
    """
    rows = answers.withColumn("domain", text.strip_dots(F.col("domain"))).where("domain <> ''")
    sightings = rows.groupBy("domain", "answer", "epoch_s").agg(
        F.count("*").alias("n"), F.sum(F.col("ttl").cast("long")).alias("ttl"), F.min("ts_iso").alias("ts_iso"))
    seconds = sightings.groupBy("domain", "epoch_s").agg(
        F.sum("n").alias("n"), F.sum("ttl").alias("ttl"), F.min("ts_iso").alias("ts_iso"))
    trailing = W.partitionBy("domain").orderBy("epoch_s").rangeBetween(-window_s, 0)
    counted = (
        seconds.withColumn("events", F.sum("n").over(trailing))
        .withColumn("_ttl", F.sum("ttl").over(trailing))
        .withColumn("first_seen", F.min("epoch_s").over(trailing))
    )
    edges = scan.presence_edges(sightings, ["domain"], "answer", "epoch_s", window_s)
    so_far = W.partitionBy("domain").orderBy("epoch_s").rowsBetween(*scan.UP_TO)
    return (
        counted.join(edges, ["domain", "epoch_s"], "full")
        .withColumn("distinct_answers", F.sum(F.coalesce("step", F.lit(0))).over(so_far).cast("long"))
        .where((F.col("events") >= min_answers) & (F.col("distinct_answers") >= min_distinct))
        .select(F.col("domain").alias("dst"), "epoch_s", F.col("ts_iso").alias("observed_at"),
                iso_of_epoch(F.col("first_seen")).alias("first_seen"), "events", "distinct_answers",
                F.expr("_ttl div events").alias("avg_ttl"))
    )


# --- BD-5 volume anomaly -----------------------------------------------------

def _pair_windows(seconds: DataFrame, window_s: int) -> DataFrame:
    """Per (host, dst, second): the volume window its flows belong to and the window's bytes before it.

    The first flow later than ``window_s`` after a window's start closes it and
    is dropped with its bytes; the next flow opens a new window. ``dropped`` is
    1 when this second's first flow closed a window, ``start`` is null when no
    flow of the second is left. ``opened`` marks the second a window starts in,
    ``first`` the pair's first second.
    """
    schema = ("host string, dst string, epoch_s long, start long, opened boolean, dropped int, first boolean, "
              "out_before long, in_before long")
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, out_sum, in_sum = None, None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            numbers = (pdf[c].tolist() for c in ("epoch_s", "n", "out_bytes", "in_bytes", "first_out", "first_in"))
            for host, dst, at, n, sent, got, first_sent, first_got in zip(pdf["host"], pdf["dst"], *numbers):
                first = (host, dst) != current
                if first:
                    current, start = (host, dst), None
                dropped = 0
                if start is not None and at - start > window_s:
                    start, dropped, n = None, 1, n - 1
                    sent, got = sent - first_sent, got - first_got
                opened = start is None and n > 0
                if opened:
                    start, out_sum, in_sum = at, 0, 0
                out.append((host, dst, at, start, opened, dropped, first, out_sum, in_sum))
                out_sum += sent
                in_sum += got
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"start": "Int64", "dropped": "int32"})

    return scan.key_sorted(seconds, ["host", "dst"], ["epoch_s"]).mapInPandas(walk, schema)


def volume_anomaly(flows: DataFrame, window_s: int = 3600, min_bytes_out: int = 10 * 1024 * 1024,
                   min_diversity: int = 8, inversion: bool = True, chunk_s: int = 60) -> DataFrame:
    """(host, dst) windows with enough bytes out that are inverted or focused.

    Focus: the host had already contacted ``min_diversity`` destinations when
    the window opened. Whole seconds of a pair are folded in order, rows are
    only ordered inside a second. A host's destinations are counted over whole
    seconds, and row by row only in seconds with a first contact.
    """
    pair = ["host", "dst"]
    rows = flows.select(
        *pair, "event_id", "epoch_s", "ts_iso",
        F.greatest(F.lit(0), F.col("out_bytes")).cast("long").alias("out_bytes"),
        F.greatest(F.lit(0), F.col("in_bytes")).cast("long").alias("in_bytes"))
    seconds = rows.groupBy(*pair, "epoch_s").agg(
        F.count("*").alias("n"), F.sum("out_bytes").alias("out_bytes"), F.sum("in_bytes").alias("in_bytes"),
        F.min(F.struct("event_id", "out_bytes", "in_bytes")).alias("_first")) \
        .select(*pair, "epoch_s", "n", "out_bytes", "in_bytes", F.col("_first.out_bytes").alias("first_out"), F.col("_first.in_bytes").alias("first_in"))
    # The fold's output is read several times below; one written copy serves all.
    windows = cut_lineage(_pair_windows(seconds, window_s))
    contacts = windows.groupBy("host", "epoch_s").agg(F.sum(F.col("first").cast("long")).alias("_new"))
    known = scan.running_sums(contacts, ["host"], "epoch_s", ["epoch_s"], {"_known": "_new"}, chunk_s)
    windows = cut_lineage(windows.join(known, ["host", "epoch_s"]))
    in_second = W.partitionBy(*pair, "epoch_s").orderBy("event_id")
    numbered = rows.withColumn("_rn", F.row_number().over(in_second)).join(windows, [*pair, "epoch_s"])
    so_far = in_second.rowsBetween(*scan.UP_TO)
    kept = F.col("_rn") > F.col("dropped")
    rows_in = (
        numbered
        .withColumn("bytes_out", F.col("out_before") + F.sum(F.when(kept, F.col("out_bytes")).otherwise(0)).over(so_far))
        .withColumn("bytes_in", F.col("in_before") + F.sum(F.when(kept, F.col("in_bytes")).otherwise(0)).over(so_far))
        .withColumn("is_new", (F.col("first") & (F.col("_rn") == 1)).cast("int"))
        .withColumn("opens", F.col("opened") & (F.col("_rn") == F.col("dropped") + 1))
        .withColumn("heavy", kept & F.col("start").isNotNull() & (F.col("bytes_out") >= min_bytes_out))
    )
    inverted = (F.col("bytes_in") > 0) & (F.col("bytes_out") > F.col("bytes_in") * 5) if inversion else F.lit(False)
    marks = rows_in.where("heavy or opens or is_new = 1") \
        .select(*pair, "event_id", "epoch_s", "ts_iso", "start", "bytes_out", "bytes_in", "is_new", "opens", "heavy", "_new", "_known")
    in_order = W.partitionBy("host", "epoch_s").orderBy("event_id", "dst").rowsBetween(*scan.UP_TO)
    ranked = cut_lineage(
        marks.where("_new = 0").withColumn("host_distinct_dests", F.col("_known"))
        .unionByName(marks.where("_new > 0").withColumn("host_distinct_dests", F.col("_known") - F.col("_new") + F.sum("is_new").over(in_order)))
        .drop("_new", "_known"))
    # Destinations known before the flow that opened the window, one row per window.
    prior = ranked.where("opens").select(*pair, "start", (F.col("host_distinct_dests") - F.col("is_new")).alias("_prior"))
    return (
        ranked.where("heavy").join(prior, [*pair, "start"])
        .withColumn("inversion", inverted)
        .withColumn("focused", (F.col("_prior") >= min_diversity) & F.lit(min_diversity > 1))
        .where("inversion or focused")
        .select(F.col("host").alias("src"), "dst", "event_id", "epoch_s", F.col("ts_iso").alias("observed_at"),
                "bytes_out", "bytes_in", "inversion", "focused", "host_distinct_dests")
    )


# --- BD-6 first-seen novelty -------------------------------------------------

def first_seen_novelty(contacts: DataFrame, ttl_s: int = DAY_S) -> DataFrame:
    """First contact of a destination by anyone, again after ``ttl_s``."""
    seconds = _first_per_second(contacts, ["dst"], ["src", "ts_iso"])
    return scan.anchored_windows(seconds, ["dst"], "epoch_s", ttl_s) \
        .select("src", "dst", "epoch_s", F.col("ts_iso").alias("observed_at"))


# --- BD-7 TLS metadata mismatch ----------------------------------------------

def tls_metadata_mismatch(tls: DataFrame) -> DataFrame:
    """Served names the certificate does not cover, and raw addresses without a name."""
    has_name = F.coalesce(F.col("sni") != "", F.lit(False))
    mismatch = F.when(has_name & ~F.col("cert_covers_sni"), "sni_not_covered") \
        .when(F.col("is_ip_https") & ~F.col("has_sni"), "raw_ip_no_sni")
    return tls.withColumn("mismatch", mismatch).where("mismatch is not null").select(
        F.col("client").alias("src"), "dst", "event_id", "epoch_s", F.col("ts_iso").alias("observed_at"), "mismatch",
        F.when(F.col("mismatch") == "sni_not_covered", F.col("sni")).alias("sni"))


# --- BD-8 synchronised first contact -----------------------------------------

def sync_first_contact(contacts: DataFrame, ttl_s: int = DAY_S, sync_window_s: int = 300, min_hosts: int = 3,
                       chunk_s: int = 10) -> DataFrame:
    """Contacts within ``sync_window_s`` of a destination's first sighting, once ``min_hosts`` hosts joined in."""
    named = contacts.withColumn("dst", text.strip_dots(F.col("dst"))).where("dst <> ''") \
        .select("src", "dst", "event_id", "ts_iso", "epoch_s")
    anchors = scan.anchored_windows(_first_per_second(named, ["dst"], ["ts_iso"]), ["dst"], "epoch_s", ttl_s) \
        .select("dst", F.col("epoch_s").alias("anchor_s"), F.col("ts_iso").alias("first_seen"))
    near = scan.within_windows(named, anchors, ["dst"], "epoch_s", "anchor_s", sync_window_s)
    joined = near.groupBy("dst", "anchor_s", "src").agg(F.min(F.struct("epoch_s", "event_id")).alias("f")) \
        .select("dst", "anchor_s", "src", "f.epoch_s", "f.event_id", F.lit(1).alias("_new"))
    flagged = near.join(joined, ["dst", "anchor_s", "src", "epoch_s", "event_id"], "left") \
        .withColumn("_new", F.coalesce("_new", F.lit(0)))
    return (
        scan.running_sums(flagged, ["dst", "anchor_s"], "epoch_s", ["epoch_s", "event_id"], {"distinct_hosts": "_new"}, chunk_s)
        .where(F.col("distinct_hosts") >= min_hosts)
        .select("dst", "event_id", "epoch_s", F.col("ts_iso").alias("observed_at"), "first_seen", "distinct_hosts")
    )


# --- suite -------------------------------------------------------------------

DETECTION_COLUMNS = ("kind", "src", "dst", "epoch_s", "observed_at", "first_seen", "events", "extra")


def as_detections(found: DataFrame, family: str) -> DataFrame:
    """Bring one family's rows to the common detection schema."""
    common = {"src", "dst", "epoch_s", "observed_at", "first_seen", "events", "event_id", "answer"}
    # The source names population-wide families report, and fixed targets.
    src = F.lit({"fastflux": "(resolver)", "sync_first_contact": "(population)"}[family]) \
        if "src" not in found.columns else F.col("src")
    dst = F.col("dst") if "dst" in found.columns else F.lit("(dns-query)")
    extras = [c for c in found.columns if c not in common]
    extra = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in extras
    ]))) if extras else F.create_map().cast("map<string,string>")
    events = F.col("events") if "events" in found.columns else F.col("queries") if "queries" in found.columns else F.lit(1)
    first_seen = F.col("first_seen") if "first_seen" in found.columns else F.col("observed_at")
    return found.select(
        F.lit(BEHAVIORAL_PREFIX + family).alias("kind"), src.alias("src"), dst.alias("dst"), "epoch_s", "observed_at",
        first_seen.alias("first_seen"), events.cast("long").alias("events"), extra.alias("extra"))


def detect(families: Iterable[str], dns_queries: DataFrame | None = None, dns_answers: DataFrame | None = None,
           flows: DataFrame | None = None, tls: DataFrame | None = None,
           options: dict[str, dict] | None = None) -> tuple[DataFrame | None, list[str]]:
    """Run the enabled families over the given frames.

    Returns the union of detections and the requested names no family answers
    to. ``options`` maps family -> keyword thresholds.
    """
    sources = {
        "beacon_periodicity": (beacon_periodicity, dns_queries), "dga_likelihood": (dga_likelihood, dns_queries),
        "dns_tunneling": (dns_tunneling, dns_queries), "fastflux": (fastflux_retained, dns_answers),
        "volume_anomaly": (volume_anomaly, flows), "first_seen_novelty": (first_seen_novelty, dns_queries),
        "tls_metadata_mismatch": (tls_metadata_mismatch, tls), "sync_first_contact": (sync_first_contact, dns_queries),
    }
    wanted = set(families)
    found = []
    for family in FAMILIES:
        run, frame = sources[family]
        if family in wanted and frame is not None:
            found.append(as_detections(run(agreeing(frame), **(options or {}).get(family, {})), family))
    union = reduce(DataFrame.unionByName, found) if found else None
    return union, sorted(wanted - set(FAMILIES))


def detections_to_evidence(detections: DataFrame) -> DataFrame:
    """Detections as local evidence records."""
    detail = F.map_concat(
        F.create_map(F.lit("client"), F.col("src"), F.lit("first_seen"), F.col("first_seen")),
        F.when(F.col("kind") == "behavioral_beacon_periodicity", F.create_map(F.lit("events"), F.col("events").cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")),
        F.col("extra"))
    return detections.select(
        F.col("dst").alias("target"), "kind", F.lit(LOCAL_SOURCE).alias("source_id"), "observed_at", "epoch_s",
        detail.alias("detail"))


def detector_health(frames: dict[str, DataFrame], keys: dict[str, list[str]], detections: DataFrame) -> DataFrame:
    """Per family: events read, events rejected for contradicting times, tracked keys, detections."""
    parts = []
    for family, frame in frames.items():
        ok = times_agree(F.col("ts_iso"), F.col("epoch_s"))
        parts.append(
            frame.groupBy(*keys[family]).agg(F.count("*").alias("seen"), F.count_if(~ok).alias("rejected"))
            .agg(F.sum("seen").alias("events_seen"), F.sum("rejected").alias("rejected"),
                 F.count_if(F.col("seen") > F.col("rejected")).alias("tracked_keys"))
            .withColumn("kind", F.lit(BEHAVIORAL_PREFIX + family)))
    emitted = detections.groupBy("kind").agg(F.count("*").alias("detections"))
    return reduce(DataFrame.unionByName, parts).join(emitted, "kind", "left") \
        .select("kind", "events_seen", "rejected", "tracked_keys", F.coalesce("detections", F.lit(0)).alias("detections"))


def newest(detections: DataFrame, keep: int = 10_000) -> DataFrame:
    """The newest ``keep`` detections; the retention bound is the feature here."""
    return detections.orderBy(F.desc("epoch_s"), "kind", "dst", "src").limit(keep)
