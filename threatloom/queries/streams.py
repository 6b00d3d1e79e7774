"""The shared tables replayed as streams: each family and state reports what its batch twin reports.

The SQL twin of a stream is that of the batch operator over the same frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.queries import detection, frames as f, requesters as batch_requesters
from threatloom.queries.frames import CONTACTS_SQL
from threatloom.queries.registry import Registry
from threatloom.streaming import families, pending, requesters
from threatloom.streaming.replay import replayed

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

HOUR, DAY = 3600, 86_400


def _replay(frame, stream, jitter_s):
    found = replayed(frame, lambda rows: stream(rows, lateness=f"{2 * jitter_s} seconds"), jitter_s=jitter_s)
    return found.where("shed is null").drop("shed") if "shed" in found.columns else found


@query("stream_bd1_beacon", detection.ORACLES["bd1_beacon_periodicity"])
def stream_bd1(spark, sf_dir):
    return _replay(f.contacts(spark, sf_dir), lambda s, lateness: families.beacon_stream(s, lateness, **detection.BEACON), HOUR)


@query("stream_bd2_dga", detection.ORACLES["bd2_dga_likelihood"])
def stream_bd2(spark, sf_dir):
    # The first page is fetched at the second 0, where every watermark begins: the replay runs a day later.
    later = f.page_queries(spark, sf_dir).withColumn("epoch_s", F.col("epoch_s") + DAY)
    found = _replay(later, lambda s, lateness: families.dga_stream(s, lateness=lateness, medium_microbits=2_000_000), HOUR)
    return found.withColumn("epoch_s", F.col("epoch_s") - DAY)


@query("stream_bd3_tunnel", detection.ORACLES["bd3_dns_tunneling"])
def stream_bd3(spark, sf_dir):
    options = {"window_queries": 50, "min_queries": 10, "min_avg_chars": 30}
    return _replay(f.tunnel_queries(spark, sf_dir), lambda s, lateness: families.tunnel_stream(s, lateness=lateness, **options), HOUR)


@query("stream_bd4_fastflux", detection.ORACLES["bd4_fastflux_retained"])
def stream_bd4(spark, sf_dir):
    return _replay(f.dns_answers(spark, sf_dir), lambda s, lateness: families.fastflux_stream(s, lateness), 3 * DAY)


@query("stream_bd5_volume", detection.ORACLES["bd5_volume_anomaly"])
def stream_bd5(spark, sf_dir):
    options = {"window_s": 2_592_000, "min_bytes_out": 8_000_000, "min_diversity": 45}
    return _replay(f.flows(spark, sf_dir), lambda s, lateness: families.volume_stream(s, lateness, **options), 3 * DAY)


@query("stream_bd6_novelty", detection.ORACLES["bd6_first_seen_novelty"])
def stream_bd6(spark, sf_dir):
    return _replay(f.contacts(spark, sf_dir), lambda s, lateness: families.first_seen_stream(s, lateness=lateness), HOUR).drop("at")


@query("stream_bd8_sync", detection.ORACLES["bd8_sync_first_contact"])
def stream_bd8(spark, sf_dir):
    return _replay(f.contacts(spark, sf_dir), lambda s, lateness: families.sync_stream(s, lateness, sync_window_s=7200, min_hosts=2), HOUR)


# Names become indicators at the first error that mentions them; a name sees a contact every few hours here, hence the long wait.
_WAIT_S, _DEPTH = 172_800, 8


@query("stream_pending_detections", f"""WITH {CONTACTS_SQL},
 k AS (SELECT 'k' || json_extract_string(props, '$.k') || '.example' AS target, min(CAST(floor(epoch(ts)) AS BIGINT)) AS seen_s
       FROM events WHERE event_type = 'error' GROUP BY 1),
 n AS (SELECT dst AS target, event_id AS entry_id, epoch_s, seen_s,
         lead(epoch_s, {_DEPTH}) OVER (PARTITION BY dst ORDER BY epoch_s, event_id) AS full_s FROM contacts LEFT JOIN k ON k.target = dst),
 o AS (SELECT *, CASE WHEN seen_s <= epoch_s THEN 'attached' WHEN full_s <= epoch_s + {_WAIT_S} AND (seen_s IS NULL OR seen_s > full_s) THEN 'overflow'
         WHEN seen_s <= epoch_s + {_WAIT_S} THEN 'attached' ELSE 'expired' END AS outcome FROM n)
SELECT target, entry_id, epoch_s, outcome, CASE WHEN outcome = 'attached' THEN 'indicator--' || target END AS indicator_id,
  CASE outcome WHEN 'attached' THEN greatest(seen_s, epoch_s) WHEN 'overflow' THEN full_s ELSE epoch_s + {_WAIT_S} END AS settled_s FROM o""")
def stream_pending(spark, sf_dir):
    contacts = f.contacts(spark, sf_dir)
    known = f.table(spark, sf_dir, "events", "props", "ts", "event_type").where("event_type = 'error'").selectExpr(
        "concat('k', get_json_object(props, '$.k'), '.example') as value", "unix_seconds(cast(ts as timestamp)) as at") \
        .groupBy("value").agg(F.min("at").alias("seen_s")).withColumn("indicator_id", F.concat(F.lit("indicator--"), "value"))
    detections = contacts.selectExpr("dst as target", "event_id as entry_id", "'behavioral_first_seen_novelty' as kind", "src", "epoch_s", "ts_iso as observed_at")
    found = _replay(pending.entries(detections, known), lambda s, lateness: pending.run_fold(s, pending.Pending(_WAIT_S, _DEPTH), lateness), HOUR)
    return found.select("target", "entry_id", "epoch_s", "outcome", "indicator_id", "settled_s")


def _requesters(spark, sf_dir, ttl_s):
    frame = batch_requesters.transactions(spark, sf_dir).withColumn("epoch_s", F.unix_seconds(F.to_timestamp("observed_at")))
    return replayed(frame, lambda s: requesters.requesters_stream(s, batch_requesters.KEY, ttl_s, lateness=f"{6 * DAY} seconds"), jitter_s=3 * DAY)


@query("stream_requester_states", batch_requesters.ORACLES["requester_states"])
def stream_requester_states(spark, sf_dir):
    """No requester expires within a hundred years."""
    states = requesters.current_requesters(_requesters(spark, sf_dir, 36_500 * DAY))
    return states.select("handle", "fingerprint", F.size("features").cast("long").alias("probe_count"), "transactions", "last_seen")


@query("stream_requester_removals", f"""WITH {batch_requesters.HANDLES_SQL},
 s AS (SELECT {batch_requesters.HANDLE_SQL} AS handle, observed_at, seen, lead(seen) OVER (PARTITION BY client_ref ORDER BY seen) AS next_seen
       FROM tx WHERE ho IS NOT NULL OR coalesce(p2, p3, p4, p5, p6) IS NOT NULL)
SELECT DISTINCT handle, observed_at AS last_seen FROM s WHERE next_seen IS NULL OR epoch(next_seen) - epoch(seen) > 180 * 86400""")
def stream_requester_removals(spark, sf_dir):
    """Silence of more than 180 days; at the end of the replay everybody has been silent for longer."""
    return _requesters(spark, sf_dir, 180 * DAY).where("removed").select("handle", "last_seen")
