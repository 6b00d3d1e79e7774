"""Pending detections, requester state and growing logs as streams, against sequential models and batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from threatloom.functions.instants import utc_literal
from threatloom.operators import correlation
from threatloom.session import ship_package
from threatloom.sources import growing
from threatloom.streaming import pending, requesters
from threatloom.streaming.replay import replayed

T0 = 1_700_000_000


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def pending_model(detections, indicators, wait_s, depth):
    """(target, entry_id) -> (outcome, indicator, second), one event after the other."""
    events = sorted([(s, 0, 0, v, i) for v, i, s in indicators] + [(at, 1, n, t, None) for t, n, at in detections])
    known, queues, out = {}, {}, {}

    def expire(target, now):
        queue = queues.get(target, [])
        while queue and queue[0][0] + wait_s < now:
            at, n = queue.pop(0)
            out[target, n] = ("expired", None, at + wait_s)

    for at, rank, n, target, indicator in events:
        expire(target, at)
        queue = queues.setdefault(target, [])
        if rank == 0:
            known.setdefault(target, indicator)
            for _, m in queue:
                out[target, m] = ("attached", known[target], at)
            queue.clear()
        elif target in known:
            out[target, n] = ("attached", known[target], at)
        else:
            if len(queue) >= depth:
                out[target, queue.pop(0)[1]] = ("overflow", None, at)
            queue.append((at, n))
    for target in queues:
        expire(target, 1 << 60)
    return out


def test_pending_equals_a_sequential_model(spark):
    rng = random.Random(8)
    detections = [(f"t{rng.randrange(6)}", n, T0 + rng.randrange(6000)) for n in range(400)]
    indicators = [("t0", "i0", T0 + 3000), ("t0", "other", T0 + 3500), ("t1", "i1", T0 - 5), ("t2", "i2", T0 + 700), ("t5", "i5", T0 + 5999), ("t9", "i9", T0)]
    det = spark.createDataFrame([(t, n, "k", f"s{n}", at, f"iso{at}") for t, n, at in detections], "target string, entry_id long, kind string, src string, epoch_s long, observed_at string")
    ind = spark.createDataFrame(indicators, "value string, indicator_id string, seen_s long")
    rows = pending.entries(det, ind)
    out = replayed(rows, lambda s: pending.run_fold(s, pending.Pending(wait_s=500, depth=4), "20 minutes"))
    got = {(r.target, r.entry_id): (r.outcome, r.indicator_id, r.settled_s) for r in out.where("shed is null").collect()}
    expected = pending_model(detections, indicators, 500, 4)
    assert got == expected and {o for o, _, _ in got.values()} == {"attached", "expired", "overflow"}


TX = "client_ref string, observed_at string, accept_language string, accept_encoding string, tls_ja4 string, cache_behavior string, range_fallback string, header_order array<string>, challenge_body_key_order array<string>"


def transactions(spark, n, clients, step_s):
    rng, rows = random.Random(9), []
    for i in range(n):
        at = T0 + rng.randrange(n) * step_s
        iso = spark_iso(at)
        rows.append((f"c{rng.randrange(clients)}", iso, "en, fr" if i % 3 else None, "gzip" if i % 2 else None, rng.choice([None, "j1", "j2"]),
                     rng.choice([None, "validators_absent"]), None, rng.choice([None, ["a", "b"], ["b"]]), None))
    return spark.createDataFrame(rows, TX)


def spark_iso(at):
    from datetime import datetime, timezone
    return datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def replay_transactions(frame, ttl_s):
    timed = frame.withColumn("epoch_s", F.coalesce(F.unix_seconds(F.try_to_timestamp("observed_at")), F.lit(T0)))
    return replayed(timed, lambda s: requesters.requesters_stream(s.drop("epoch_s"), None, ttl_s, lateness="20 minutes"))


def test_requester_state_equals_batch_while_nothing_expires(spark):
    frame = transactions(spark, 300, 7, 60)
    out = requesters.current_requesters(replay_transactions(frame, 500 * 86_400)).collect()
    expected = correlation.requester_states(frame, None).collect()
    as_rows = lambda rows: sorted((r.handle, sorted(r.features.items()), r.transactions, r.last_seen, r.fingerprint) for r in rows)
    assert as_rows(out) == as_rows(expected) and expected


def test_silent_requesters_are_removed_and_start_anew(spark):
    iso = lambda h: spark_iso(T0 + h * 3600)
    row = lambda c, h, ja4: (c, iso(h), None, None, ja4, None, None, None, None)
    frame = spark.createDataFrame([row("a", 0, "x"), row("a", 1, "y"), row("a", 30, "z"), row("b", 0, "x"), row("far", 9000, "x"), ("bad", "never", None, None, "x", None, None, None, None)], TX)
    assert {r.handle for r in requesters.admitted(frame, None, 10 * 3600, utc_literal(iso(31))).collect()} == {"a", "b"}
    out = replay_transactions(frame.where("client_ref <> 'far'"), 10 * 3600)
    rows = out.where("shed is null").collect()
    last = {r.handle: (r.transactions, r.last_seen) for r in rows if not r.removed and r.version >= T0 + (30 * 3600 if r.handle == "a" else 0)}
    assert last == {"a": (1, iso(30)), "b": (1, iso(0))}
    assert sorted((r.handle, r.last_seen) for r in rows if r.removed) == [("a", iso(1)), ("a", iso(30)), ("b", iso(0))]
    assert requesters.current_requesters(out).count() == 0


def drain(spark, path, out, checkpoint):
    query = growing.growing_log(spark, str(path)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(once=True).start()
    query.awaitTermination(120)
    return sorted(r.line for r in spark.read.schema("line string, inode long, offset long").parquet(str(out)).collect())


def test_growing_log_holds_back_torn_lines_and_resumes(spark, tmp_path):
    log, out, ck = tmp_path / "eve.json", tmp_path / "out", tmp_path / "ck"
    log.write_text("one\nto")
    assert drain(spark, log, out, ck) == ["one"]
    assert drain(spark, log, out, ck) == ["one"]
    with log.open("a") as f:
        f.write("rn\nthree\n")
    assert drain(spark, log, out, ck) == ["one", "three", "torn"]


def test_growing_log_follows_rotation_and_truncation(spark, tmp_path):
    log, out, ck = tmp_path / "eve.json", tmp_path / "out", tmp_path / "ck"
    log.write_text("old\n")
    assert drain(spark, log, out, ck) == ["old"]
    with log.open("a") as f:
        f.write("last of old\n")
    log.rename(tmp_path / "eve.json.1")
    log.write_text("new\n")
    assert drain(spark, log, out, ck) == ["last of old", "new", "old"]
    log.write_text("x\n")
    assert drain(spark, log, out, ck) == ["last of old", "new", "old", "x"]


def test_ranges_split_lines_once(tmp_path):
    log = tmp_path / "log"
    lines = ["x" * n for n in (0, 5, 1, 30, 2, 0, 0, 7)]
    log.write_text("".join(f"{x}\n" for x in lines))
    inode, size = log.stat().st_ino, log.stat().st_size
    for step in range(1, size + 1):
        parts = [growing.Range(str(log), inode, at, min(at + step, size), at == 0) for at in range(0, size, step)]
        assert [line for p in parts for line, _, _ in growing.lines_of(p)] == lines


def test_passes_are_bounded(tmp_path):
    log = tmp_path / "log"
    log.write_text("".join(f"line {k}\n" for k in range(50)))
    reader = growing.GrowingReader(str(log), 40)
    at, seen = reader.initialOffset(), []
    for _ in range(60):
        end = reader.latestOffset()
        part = reader.partitions(at, end)
        taken = [line for p in part for line, _, _ in reader.read(p)]
        assert len(taken) <= 6
        seen, at = seen + taken, end
    assert seen == [f"line {k}" for k in range(50)]
