"""Detectors against small sequential models, with a hot key and same-second ties."""

import random
from collections import defaultdict

import pytest

from threatloom.operators import detectors as d
from threatloom.operators import scan
from threatloom.session import ship_package

T0 = 1_700_000_000
CONTACT = "event_id long, src string, dst string, qtype string, ts_iso string, epoch_s long"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def events(n, step, hosts=6, names=5, seed=1):
    """Event tuples in time order; one name and one host hold about a third of them."""
    rng, at, rows = random.Random(seed), T0, []
    for i in range(n):
        at += rng.choice(step)
        src = "u0" if rng.random() < 0.33 else f"u{rng.randrange(hosts)}"
        dst = "hot.example" if rng.random() < 0.33 else f"n{rng.randrange(names)}.example"
        rows.append((i, src, dst, rng.choice(["A", "TXT", None]), f"iso-{i}", at))
    return rows


def beacon_model(rows, need=6, tol=250_000, low=10, high=3600):
    state, out = {}, []
    for _, src, dst, _, iso, at in rows:
        s = state.get((src, dst))
        if s is None:
            state[(src, dst)] = {"last": at, "gaps": [], "total": 0, "sent": 0, "birth": iso}
            continue
        if at <= s["last"]:
            continue
        s["gaps"] = (s["gaps"] + [at - s["last"]])[-(need + 64):]
        s["last"], s["total"] = at, s["total"] + 1
        if s["total"] - s["sent"] < need:
            continue
        g = sorted(s["gaps"])
        mid = len(g) // 2
        med = g[mid] if len(g) % 2 else (g[mid - 1] + g[mid]) // 2
        if low <= med <= high and all(abs(x - med) * 1_000_000 // med <= tol for x in g):
            s["sent"] = s["total"]
            out.append((src, dst, at, iso, s["birth"], len(g), med))
    return sorted(out)


def test_beacon(spark):
    rng, rows, i = random.Random(5), [], 0
    for pair in range(5):
        at = T0 + pair
        for k in range(160 if pair == 0 else 30):
            at += rng.choice([60, 61, 62, 0]) if pair < 4 else rng.choice([5, 900])
            rows.append((i, f"u{pair}", "c2.example", None, f"iso-{i}", at))
            i += 1
    rows.sort(key=lambda r: (r[5], r[0]))
    got = d.beacon_periodicity(spark.createDataFrame(rows, CONTACT))
    got = sorted(tuple(r) for r in got.select("src", "dst", "epoch_s", "observed_at", "first_seen", "events", "median_gap_s").collect())
    assert got == beacon_model(rows) and any(r[5] == 70 for r in got)


def anchors_model(rows, key, ttl):
    last, out = {}, []
    for r in rows:
        k = key(r)
        if k not in last or r[5] - last[k] > ttl:
            last[k] = r[5]
            out.append(r)
    return out


def test_novelty_and_generated_names(spark):
    rows = events(300, [0, 1, 500, 3000])
    got = d.first_seen_novelty(spark.createDataFrame(rows, CONTACT), ttl_s=3600)
    expected = sorted((r[1], r[2], r[5], r[4]) for r in anchors_model(rows, lambda r: r[2], 3600))
    assert sorted(tuple(r) for r in got.collect()) == expected

    names = [(1, "u", "x7fjq2m9zk4p8w.invalid.", "A", "a", T0), (2, "u", "www.example", "A", "b", T0 + 1), (3, "v", "x7fjq2m9zk4p8w.invalid", "A", "c", T0 + 50),
             (4, "u", "abcdefgh.example", "A", "d", T0 + 2), (5, "u", "...", "A", "e", T0), (6, "w", "x7fjq2m9zk4p8w.invalid", "A", "f", T0 + 90_000)]
    found = {(r.src, r.dst, r.epoch_s - T0): (r.band, r.label_len) for r in d.dga_likelihood(spark.createDataFrame(names, CONTACT)).collect()}
    assert found == {("u", "x7fjq2m9zk4p8w.invalid", 0): ("high", 14), ("w", "x7fjq2m9zk4p8w.invalid", 90_000): ("high", 14), ("u", "abcdefgh.example", 2): ("high", 8)}


def tunnel_model(rows, window, need, long_len, share, avg):
    state, out = {}, []
    for event_id, src, dst, qtype, iso, at in rows:
        s = state.setdefault(src, {"n": 0, "long": 0, "chars": 0, "data": 0, "last": None})
        if s["last"] is not None and at - s["last"] > 3600:
            s.update(n=0, long=0, chars=0, data=0)
        label = dst.split(".")[0]
        s["n"] += 1
        s["last"] = at
        if len(label) >= long_len:
            s["long"] += 1
            s["data"] += qtype == "TXT"
        s["chars"] += len(label)
        if s["n"] >= window:
            s.update(n=0, long=0, chars=0, data=0)
        if s["n"] < need:
            continue
        if s["long"] * 1_000_000 // s["n"] >= share and s["chars"] // s["n"] >= avg:
            out.append((src, event_id, s["n"], s["long"] * 1_000_000 // s["n"], s["chars"] // s["n"], s["data"]))
    return sorted(out)


def test_tunnelling_blocks_and_idle_resets(spark):
    rng, rows, at = random.Random(9), [], T0
    long_label = "0123456789abcdefghijklmnopqrstuvwxyz"
    for i in range(900):
        at += rng.choice([0, 1, 2, 40, 40, 5000]) if i % 97 == 0 else rng.choice([0, 1, 20])
        src = "hot" if rng.random() < 0.6 else f"c{rng.randrange(3)}"
        rows.append((i, src, (long_label if rng.random() < 0.5 else "www") + ".t.example", rng.choice(["TXT", "A"]), f"iso-{i}", at))
    got = d.dns_tunneling(spark.createDataFrame(rows, CONTACT), window_queries=50, min_queries=10, min_avg_chars=10)
    got = sorted(tuple(r) for r in got.select("src", "event_id", "queries", "share_micros", "avg_label_chars", "data_type_queries").collect())
    assert got == tunnel_model(rows, 50, 10, 24, 350_000, 10) and len(got) > 100
    with pytest.raises(ValueError):
        d.dns_tunneling(spark.createDataFrame(rows, CONTACT), chunk_s=7200)


def test_fastflux_retained_list(spark):
    rng, rows, at = random.Random(11), [], T0
    for i in range(500):
        at += rng.choice([0, 0, 10, 4000, 30_000])
        rows.append((i, "hot.example." if rng.random() < 0.5 else f"d{rng.randrange(3)}.example", f"10.0.0.{rng.randrange(12)}", rng.randrange(300), f"iso-{i}", at))
    state, out = {}, []
    for event_id, domain, answer, ttl, _, at in rows:
        s = state.setdefault(domain.rstrip("."), {"answers": set(), "ttl": 0, "times": []})
        s["answers"].add(answer)
        s["ttl"] += ttl
        s["times"].append(at)
        if at - s["times"][0] > 86_400:
            s["times"] = s["times"][-8:]
        if len(s["times"]) >= 8 and len(s["answers"]) >= 5:
            out.append((domain.rstrip("."), event_id, len(s["times"]), len(s["answers"]), s["ttl"] // len(s["times"])))
    frame = spark.createDataFrame(rows, "event_id long, domain string, answer string, ttl long, ts_iso string, epoch_s long")
    got = d.fastflux_retained(frame).select("dst", "event_id", "events", "distinct_answers", "avg_ttl")
    assert sorted(tuple(r) for r in got.collect()) == sorted(out) and len(out) > 50


def test_volume_windows(spark):
    rng, rows, at = random.Random(13), [], T0
    for i in range(700):
        at += rng.choice([0, 0, 30, 900, 2500])
        host = "hot" if rng.random() < 0.4 else f"h{rng.randrange(3)}"
        dst = "sink" if rng.random() < 0.3 else f"d{rng.randrange(8)}"
        rows.append((i, host, dst, rng.randrange(-5, 400), rng.choice([0, 3, 200]), f"iso-{i}", at))
    pairs, known, out = {}, defaultdict(set), []
    for event_id, host, dst, sent, got, _, at in rows:
        s = pairs.get((host, dst))
        if s is None:
            s = pairs[(host, dst)] = {"t0": at, "out": 0, "in": 0, "focus": len(known[host]) >= 4}
            known[host].add(dst)
        s["out"] += max(0, sent)
        s["in"] += max(0, got)
        if at - s["t0"] > 3600:
            del pairs[(host, dst)]
            continue
        inverted = s["in"] > 0 and s["out"] > s["in"] * 5
        if s["out"] >= 150 and (inverted or s["focus"]):
            out.append((host, dst, event_id, s["out"], s["in"], inverted, s["focus"], len(known[host])))
    frame = spark.createDataFrame(rows, "event_id long, host string, dst string, out_bytes long, in_bytes long, ts_iso string, epoch_s long")
    got = d.volume_anomaly(frame, min_bytes_out=150, min_diversity=4).drop("epoch_s", "observed_at")
    assert sorted(tuple(r) for r in got.collect()) == sorted(out) and len(out) > 50


def test_sync_first_contact(spark):
    rows = events(600, [0, 5, 20, 60, 4000])
    state, out = {}, []
    for event_id, src, dst, _, _, at in rows:
        s = state.setdefault(dst, {"t0": at, "hosts": set()})
        s["hosts"].add(src)
        if at - s["t0"] > 3600:
            s.update(t0=at, hosts={src})
        if len(s["hosts"]) >= 3 and at - s["t0"] <= 300:
            out.append((dst, event_id, len(s["hosts"])))
    got = d.sync_first_contact(spark.createDataFrame(rows, CONTACT), ttl_s=3600)
    assert sorted(tuple(r) for r in got.select("dst", "event_id", "distinct_hosts").collect()) == sorted(out) and len(out) > 10


def test_order_of_input_never_matters(spark):
    rows = events(200, [0, 5, 400])
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for run in (d.first_seen_novelty, d.beacon_periodicity, d.sync_first_contact):
        a, b = (sorted(map(str, run(spark.createDataFrame(r, CONTACT)).collect())) for r in (rows, shuffled))
        assert a == b


def test_running_sums_equal_one_window(spark):
    rows = [(r[1], r[5], r[0], r[0] % 7) for r in events(400, [0, 3, 100])]
    frame = spark.createDataFrame(rows, "k string, at long, id long, v long")
    chunked = {(r.k, r.id): r.total for r in scan.running_sums(frame, ["k"], "at", ["at", "id"], {"total": "v"}, 60).collect()}
    sums, expected = defaultdict(int), {}
    for k, _, i, v in rows:
        sums[k] += v
        expected[(k, i)] = sums[k]
    assert chunked == expected


def test_suite_reports_unknown_families_and_rejects_contradicting_times(spark):
    rows = [(1, "u", "a.example", "A", "2023-11-14T22:13:20Z", T0), (2, "u", "b.example", "A", "2023-11-14T23:13:20Z", T0), (3, "u", "c.example", "A", "no time", T0)]
    found, unknown = d.detect(["first_seen_novelty", "clairvoyance"], dns_queries=spark.createDataFrame(rows, CONTACT))
    assert unknown == ["clairvoyance"] and sorted(r.dst for r in found.collect()) == ["a.example", "c.example"]
    evidence = d.detections_to_evidence(found).collect()
    assert all(r.detail["client"] == "u" and r.source_id == "local-behavioral" for r in evidence)
