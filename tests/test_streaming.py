"""Streams give what batches give, across micro-batches, restarts and replays."""

import json
import random

import pytest

from threatloom.operators import detectors
from threatloom.session import ship_package
from threatloom.sources import eve
from threatloom.streaming import attach, detect, sinks

CONTACT = "event_id long, src string, dst string, ts_iso string, epoch_s long"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def contacts(n=240, seed=3):
    rng = random.Random(seed)
    at = 1_700_000_000
    rows = []
    for i in range(n):
        at += rng.choice([0, 5, 300, 4000])
        rows.append((i, f"u{rng.randrange(5)}", f"d{rng.randrange(4)}.example", f"iso-{i}", at))
    return rows


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w") as out:
        for row in rows:
            out.write(json.dumps(dict(zip(("event_id", "src", "dst", "ts_iso", "epoch_s"), row))) + "\n")


def drain(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(CONTACT).option("maxFilesPerTrigger", 1).json(str(folder))
    found = detect.first_seen_stream(stream, ttl_s=3600, lateness="2 hours")
    query = found.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)) \
        .outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_first_seen_stream_equals_batch_out_of_order_and_after_restart(spark, tmp_path):
    rows = contacts()
    order = rows[:]
    for i in range(0, len(order) - 1, 7):       # neighbours swap places, within the lateness
        order[i], order[i + 1] = order[i + 1], order[i]
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    put(folder, "a.json", order[:80])
    put(folder, "b.json", order[80:160])
    drain(spark, folder, out, checkpoint)
    put(folder, "c.json", order[160:])
    put(folder, "z.json", [(9_999, "end", "end.example", "iso-end", rows[-1][4] + 50_000)])   # moves the watermark past everything
    put(folder, "zz.json", [(10_000, "end", "end.example", "iso-end", rows[-1][4] + 50_001)])
    drain(spark, folder, out, checkpoint)
    streamed = {tuple(r) for r in spark.read.parquet(str(out)).select("src", "dst", "epoch_s", "observed_at").collect()}
    batch = detectors.first_seen_novelty(spark.createDataFrame(rows, CONTACT), ttl_s=3600)
    expected = {tuple(r) for r in batch.select("src", "dst", "epoch_s", "observed_at").collect()}
    assert expected and {r for r in streamed if r[1] != "end.example"} == expected


def test_append_once_survives_replay(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1)], "k string, v int")
    second = spark.createDataFrame([("b", 1), ("c", 1)], "k string, v int")
    sinks.append_once(first, 0, path, ["k"])
    sinks.append_once(second, 1, path, ["k"])
    sinks.append_once(second, 1, path, ["k"])   # the same micro-batch again
    sinks.append_once(first, 2, path, ["k"])    # the same data in a new batch
    rows = spark.read.parquet(path).collect()
    assert sorted((r.k, r.micro_batch) for r in rows) == [("a", 0), ("b", 0), ("c", 1)]


def test_attach_stream_matches_late_indicator_and_expires_the_rest(spark, tmp_path):
    def stream(name, schema, batches):
        folder = tmp_path / name
        folder.mkdir()
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    det = stream("det", "target string, kind string, epoch_s long, observed_at string",
                 [[("x", "k", 1000, "t"), ("y", "k", 1000, "t")], [("end", "k", 90_000, "t")], [("end", "k", 90_001, "t")]])
    ind = stream("ind", "value string, indicator_id string, seen_s long",
                 [[("x", "ix", 1500), ("y", "iy", 5000)], [("q", "iq", 90_000)], [("q", "iq", 90_001)]])
    query = attach.attach_stream(det, ind).writeStream.format("memory").queryName("attached").option("checkpointLocation", str(tmp_path / "ck")) \
        .outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.target: r.indicator_id for r in spark.sql("select * from attached").collect() if r.target != "end"}
    assert got == {"x": "ix", "y": None}


def test_eve_stream_resumes_and_matches_batch(spark, tmp_path):
    folder = tmp_path / "eve"
    folder.mkdir()
    line = lambda i: json.dumps({"timestamp": f"2026-09-01T19:00:{i:02d}Z", "event_type": "dns", "src_ip": "10.0.0.1", "rrname": f"n{i}.example"})
    (folder / "1.json").write_text("\n".join(line(i) for i in range(5)) + "\nbroken\n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: sinks.start_append(eve.dns_queries(detect.eve_stream(spark, str(folder))), out, ["event_id"], ck).awaitTermination(60)
    run()
    (folder / "2.json").write_text("\n".join(line(i) for i in range(5, 8)) + "\n")
    run()
    assert sorted(r.dst for r in spark.read.parquet(out).collect()) == [f"n{i}.example" for i in range(8)]
