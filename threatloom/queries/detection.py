"""Detector queries over the shared tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.operators import capacity, detectors as d
from threatloom.operators import scan
from threatloom.queries import frames as f
from threatloom.queries.frames import ANSWERS_SQL, CONTACTS_SQL, FLOWS_SQL, PAGES_SQL, TLS_SQL, TUNNEL_SQL
from threatloom.queries.registry import Registry

# Entropy with counts in ascending order, so both engines add in one order.
ENTROPY_SQL = """CASE WHEN length({x}) <= 1 THEN 0 ELSE CAST(round_even(list_reduce(list_prepend(CAST(0 AS DOUBLE),
    list_transform(list_sort(list_transform(list_distinct(string_split({x}, '')), lambda c: length({x}) - length(replace({x}, c, '')))),
      lambda n: n * (log2(length({x})) - log2(n)))), lambda a, b: a + b) / length({x}) * 1000000.0, 0) AS BIGINT) END"""

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


# Gaps between contacts of one (user, name) pair span days here, hence the wide medians.
BEACON = {"min_events": 4, "tolerance_micros": 900_000, "min_median_s": 10, "max_median_s": 10_000_000}

QUERIES_SQL_BEACON = f"""WITH RECURSIVE {CONTACTS_SQL},
 s AS (SELECT src, dst, epoch_s, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2, 3),
 g AS (SELECT *, epoch_s - lag(epoch_s) OVER w AS gap, first_value(ts_iso) OVER w AS first_seen FROM s
       WINDOW w AS (PARTITION BY src, dst ORDER BY epoch_s)),
 n AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY epoch_s) AS gap_no,
         list_sort(list(gap) OVER (PARTITION BY src, dst ORDER BY epoch_s ROWS BETWEEN 67 PRECEDING AND CURRENT ROW)) AS gaps
       FROM g WHERE gap IS NOT NULL),
 m AS (SELECT *, len(gaps) AS events, CASE WHEN len(gaps) % 2 = 1 THEN gaps[len(gaps) // 2 + 1]
         ELSE (gaps[len(gaps) // 2] + gaps[len(gaps) // 2 + 1]) // 2 END AS median_gap_s FROM n WHERE gap_no >= 4),
 ok AS (SELECT * FROM m WHERE median_gap_s BETWEEN 10 AND 10000000
          AND len(list_filter(gaps, lambda x: abs(x - median_gap_s) * 1000000 // median_gap_s > 900000)) = 0),
 e AS (SELECT src, dst, min(gap_no) AS gap_no FROM ok GROUP BY 1, 2
       UNION ALL SELECT e.src, e.dst, min(ok.gap_no) FROM e JOIN ok ON ok.src = e.src AND ok.dst = e.dst AND ok.gap_no > e.gap_no + 3
       GROUP BY e.src, e.dst, e.gap_no)
SELECT src, dst, epoch_s, ts_iso AS observed_at, first_seen, CAST(events AS BIGINT) AS events, median_gap_s
FROM ok JOIN e USING (src, dst, gap_no)"""


@query("bd1_beacon_periodicity", QUERIES_SQL_BEACON)
def bd1(spark, sf_dir):
    return d.beacon_periodicity(f.contacts(spark, sf_dir), **BEACON)


@query("bd2_dga_likelihood", f"""WITH RECURSIVE {PAGES_SQL},
 s AS (SELECT regexp_replace(dst, '\\.+$', '') AS dst, epoch_s, min(struct_pack(event_id := event_id, src := src, ts_iso := ts_iso)) AS f
       FROM page_queries WHERE dst <> '' GROUP BY 1, 2),
 a AS (SELECT dst, min(epoch_s) AS epoch_s FROM s GROUP BY 1
       UNION ALL SELECT s.dst, min(s.epoch_s) FROM a JOIN s ON s.dst = a.dst AND s.epoch_s > a.epoch_s + 86400 GROUP BY s.dst, a.epoch_s),
 l AS (SELECT s.f.src AS src, dst, epoch_s, s.f.ts_iso AS observed_at, split_part(dst, '.', 1) AS label FROM a JOIN s USING (dst, epoch_s)),
 h AS (SELECT *, {ENTROPY_SQL.format(x='label')} AS entropy_microbits FROM l)
SELECT src, dst, epoch_s, observed_at, CASE WHEN entropy_microbits >= 2850000 THEN 'high' ELSE 'medium' END AS band, entropy_microbits,
  CAST(length(label) AS BIGINT) AS label_len, CAST(len(string_split(dst, '.')) AS BIGINT) AS label_depth
FROM h WHERE entropy_microbits >= 2000000""")
def bd2(spark, sf_dir):
    return d.dga_likelihood(f.page_queries(spark, sf_dir), medium_microbits=2_000_000)


@query("bd3_dns_tunneling", f"""WITH {TUNNEL_SQL},
 r AS (SELECT *, length(label) AS chars, length(label) >= 24 AND {ENTROPY_SQL.format(x='label')} >= 3100000 AS long_label,
         epoch_s - lag(epoch_s) OVER (PARTITION BY src ORDER BY epoch_s, event_id) > 3600 AS idle FROM tunnel),
 s AS (SELECT *, sum(CASE WHEN idle THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY epoch_s, event_id) AS session FROM r),
 n AS (SELECT *, row_number() OVER (PARTITION BY src, session ORDER BY epoch_s, event_id) - 1 AS pos FROM s),
 b AS (SELECT *, pos % 50 + 1 AS queries, sum(CASE WHEN long_label THEN 1 ELSE 0 END) OVER w AS n_long, sum(chars) OVER w AS n_chars,
         sum(CASE WHEN long_label AND qtype = 'TXT' THEN 1 ELSE 0 END) OVER w AS n_data
       FROM n WINDOW w AS (PARTITION BY src, session, pos // 50 ORDER BY pos))
SELECT src, event_id, epoch_s, ts_iso AS observed_at, CAST(queries AS BIGINT) AS queries, CAST(n_long * 1000000 // queries AS BIGINT) AS share_micros,
  CAST(n_chars // queries AS BIGINT) AS avg_label_chars, CAST(n_data AS BIGINT) AS data_type_queries
FROM b WHERE queries >= 10 AND queries < 50 AND n_long * 1000000 // queries >= 350000 AND n_chars // queries >= 30""")
def bd3(spark, sf_dir):
    # One user of five sends a query every few minutes here: smaller blocks than the defaults.
    return d.dns_tunneling(f.tunnel_queries(spark, sf_dir), window_queries=50, min_queries=10, min_avg_chars=30)


@query("bd4_fastflux_retained", f"""WITH RECURSIVE {ANSWERS_SQL},
 o AS (SELECT *, row_number() OVER w AS k, sum(ttl) OVER w AS ttl_sum,
         row_number() OVER (PARTITION BY domain, answer ORDER BY epoch_s, event_id) = 1 AS is_new
       FROM answers WINDOW w AS (PARTITION BY domain ORDER BY epoch_s, event_id, answer)),
 u AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY k) AS distinct_answers FROM o),
 t AS (SELECT domain, list(epoch_s ORDER BY k) AS times FROM o GROUP BY domain),
 h AS (SELECT domain, 1::BIGINT AS k, 1::BIGINT AS head FROM t
       UNION ALL SELECT h.domain, h.k + 1, CASE WHEN times[h.k + 1] - times[h.head] > 86400 THEN greatest(h.head, h.k + 1 - 7) ELSE h.head END
       FROM h JOIN t USING (domain) WHERE h.k < len(times))
SELECT domain AS dst, event_id, answer, epoch_s, ts_iso AS observed_at,
  strftime(to_timestamp(times[head]) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first_seen, k - head + 1 AS events,
  CAST(distinct_answers AS BIGINT) AS distinct_answers, CAST(ttl_sum // (k - head + 1) AS BIGINT) AS avg_ttl
FROM u JOIN h USING (domain, k) JOIN t USING (domain) WHERE k - head + 1 >= 8 AND distinct_answers >= 5""")
def bd4_retained(spark, sf_dir):
    return d.fastflux_retained(f.dns_answers(spark, sf_dir))


@query("bd4_fastflux_windowed", f"""WITH {ANSWERS_SQL},
 s AS (SELECT domain, epoch_s, min(ts_iso) AS ts_iso FROM answers GROUP BY 1, 2),
 w AS (SELECT s.domain, s.epoch_s, s.ts_iso, count(*) AS events, count(DISTINCT a.answer) AS distinct_answers, min(a.epoch_s) AS first_s, sum(a.ttl) AS ttl
       FROM s JOIN answers a ON a.domain = s.domain AND a.epoch_s BETWEEN s.epoch_s - 31536000 AND s.epoch_s GROUP BY 1, 2, 3)
SELECT domain AS dst, epoch_s, ts_iso AS observed_at, strftime(to_timestamp(first_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first_seen,
  events, distinct_answers, CAST(ttl // events AS BIGINT) AS avg_ttl
FROM w WHERE events >= 6 AND distinct_answers >= 5""")
def bd4_windowed(spark, sf_dir):
    # Ship dates have day resolution: a one-year window instead of 24 h.
    return d.fastflux_windowed(f.dns_answers(spark, sf_dir), min_answers=6, window_s=31_536_000)


@query("bd5_volume_anomaly", f"""WITH RECURSIVE {FLOWS_SQL},
 o AS (SELECT *, row_number() OVER (PARTITION BY host, dst ORDER BY epoch_s, event_id) AS k FROM flows),
 f AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY epoch_s, event_id, dst) AS host_dests FROM o),
 r AS (SELECT host, dst, k, epoch_s AS start, true AS opened, host_dests - 1 AS prior, out_bytes AS bo, in_bytes AS bi FROM f WHERE k = 1
   UNION ALL
   SELECT f.host, f.dst, f.k,
     CASE WHEN r.start IS NULL THEN f.epoch_s WHEN f.epoch_s - r.start > 2592000 THEN NULL ELSE r.start END,
     r.start IS NULL, CASE WHEN r.start IS NULL THEN f.host_dests ELSE r.prior END,
     CASE WHEN r.start IS NULL THEN f.out_bytes ELSE r.bo + f.out_bytes END, CASE WHEN r.start IS NULL THEN f.in_bytes ELSE r.bi + f.in_bytes END
   FROM r JOIN f ON f.host = r.host AND f.dst = r.dst AND f.k = r.k + 1)
SELECT f.host AS src, f.dst, f.event_id, f.epoch_s, f.ts_iso AS observed_at, bo AS bytes_out, bi AS bytes_in, bi > 0 AND bo > bi * 5 AS inversion,
  prior >= 45 AS focused, CAST(host_dests AS BIGINT) AS host_distinct_dests
FROM r JOIN f USING (host, dst, k) WHERE start IS NOT NULL AND bo >= 8000000 AND ((bi > 0 AND bo > bi * 5) OR prior >= 45)""")
def bd5(spark, sf_dir):
    return d.volume_anomaly(f.flows(spark, sf_dir), window_s=2_592_000, min_bytes_out=8_000_000, min_diversity=45, chunk_s=86_400)


_ANCHORS_SQL = """a AS (SELECT dst, min(epoch_s) AS epoch_s FROM s GROUP BY 1
       UNION ALL SELECT s.dst, min(s.epoch_s) FROM a JOIN s ON s.dst = a.dst AND s.epoch_s > a.epoch_s + 86400 GROUP BY s.dst, a.epoch_s)"""


@query("bd6_first_seen_novelty", f"""WITH RECURSIVE {CONTACTS_SQL},
 s AS (SELECT dst, epoch_s, arg_min(src, event_id) AS src, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2),
 {_ANCHORS_SQL}
SELECT src, dst, epoch_s, ts_iso AS observed_at FROM a JOIN s USING (dst, epoch_s)""")
def bd6(spark, sf_dir):
    return d.first_seen_novelty(f.contacts(spark, sf_dir))


@query("bd7_tls_metadata_mismatch", f"""WITH {TLS_SQL},
 m AS (SELECT *, CASE WHEN sni <> '' AND NOT cert_covers_sni THEN 'sni_not_covered' WHEN is_ip_https AND NOT has_sni THEN 'raw_ip_no_sni' END AS mismatch FROM tls)
SELECT client AS src, dst, event_id, epoch_s, ts_iso AS observed_at, mismatch, CASE WHEN mismatch = 'sni_not_covered' THEN sni END AS sni
FROM m WHERE mismatch IS NOT NULL""")
def bd7(spark, sf_dir):
    return d.tls_metadata_mismatch(f.tls(spark, sf_dir))


@query("bd8_sync_first_contact", f"""WITH RECURSIVE {CONTACTS_SQL},
 s AS (SELECT dst, epoch_s, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2),
 {_ANCHORS_SQL},
 n AS (SELECT c.dst, a.epoch_s AS anchor_s, s.ts_iso AS first_seen, c.src, c.event_id, c.epoch_s, c.ts_iso
       FROM contacts c JOIN a ON a.dst = c.dst AND c.epoch_s BETWEEN a.epoch_s AND a.epoch_s + 7200 JOIN s ON s.dst = a.dst AND s.epoch_s = a.epoch_s),
 k AS (SELECT *, row_number() OVER (PARTITION BY dst, anchor_s, src ORDER BY epoch_s, event_id) = 1 AS is_new FROM n),
 u AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY dst, anchor_s ORDER BY epoch_s, event_id) AS distinct_hosts FROM k)
SELECT dst, event_id, epoch_s, ts_iso AS observed_at, first_seen, CAST(distinct_hosts AS BIGINT) AS distinct_hosts FROM u WHERE distinct_hosts >= 2""")
def bd8(spark, sf_dir):
    # A name sees a contact every few hours here: a two-hour window and two hosts.
    return d.sync_first_contact(f.contacts(spark, sf_dir), sync_window_s=7200, min_hosts=2, chunk_s=600)


@query("anchored_ttl_windows", f"""WITH RECURSIVE {CONTACTS_SQL},
 s AS (SELECT src, epoch_s, count(*) AS n FROM contacts GROUP BY 1, 2),
 a AS (SELECT src, min(epoch_s) AS epoch_s FROM s GROUP BY 1
       UNION ALL SELECT s.src, min(s.epoch_s) FROM a JOIN s ON s.src = a.src AND s.epoch_s > a.epoch_s + 3600 GROUP BY s.src, a.epoch_s)
SELECT src, epoch_s, n FROM a JOIN s USING (src, epoch_s)""")
def anchored(spark, sf_dir):
    seconds = f.contacts(spark, sf_dir).groupBy("src", "epoch_s").agg(F.count("*").alias("n"))
    return scan.anchored_windows(seconds, ["src"], "epoch_s", 3600)


# Small capacities, so that every family fills up: (frame, key columns, capacity, what a full table does).
_BOUNDED = {
    "beacon_periodicity": ("contacts", ("src", "dst"), 1000, "ignore"), "first_seen_novelty": ("contacts", ("dst",), 60, "stop"),
    "sync_first_contact": ("contacts", ("dst",), 1_000_000, "stop"), "dns_tunneling": ("tunnel", ("src",), 3, "stop"),
    "fastflux": ("answers", ("domain",), 500, "stop"), "volume_anomaly": ("flows", ("host", "dst"), 900, "stop"), "tls_metadata_mismatch": ("tls", ("client", "dst"), 700, "stop"),
}


def _bounded_sql(family: str) -> str:
    frame, keys, limit, full = _BOUNDED[family]
    by = ", ".join(keys)
    shed = f"sum(n) FILTER (place > {limit})" if full == "ignore" else \
        f"(SELECT count(*) FROM {frame}, (SELECT f FROM p WHERE place = {limit + 1}) AS s WHERE struct_pack(epoch_s := {frame}.epoch_s, event_id := {frame}.event_id) >= s.f)"
    return f"""SELECT 'behavioral_{family}' AS kind, CAST({limit} AS BIGINT) AS capacity, count(*) FILTER (place <= {limit}) AS tracked_keys,
      count(*) FILTER (place > {limit}) AS shed_keys, CAST(coalesce({shed}, 0) AS BIGINT) AS shed_events, count(*) > {limit} AS degraded
    FROM (WITH p AS (SELECT *, row_number() OVER (ORDER BY f, {by}) AS place FROM (SELECT {by}, min(struct_pack(epoch_s := epoch_s, event_id := event_id)) AS f, count(*) AS n FROM {frame} GROUP BY {by})) SELECT * FROM p)""" \
        if full == "ignore" else f"""SELECT * FROM (WITH p AS (SELECT *, row_number() OVER (ORDER BY f, {by}) AS place FROM (SELECT {by}, min(struct_pack(epoch_s := epoch_s, event_id := event_id)) AS f FROM {frame} GROUP BY {by}))
      SELECT 'behavioral_{family}' AS kind, CAST({limit} AS BIGINT) AS capacity, count(*) FILTER (place <= {limit}) AS tracked_keys,
        count(*) FILTER (place > {limit}) AS shed_keys, CAST(coalesce({shed}, 0) AS BIGINT) AS shed_events, count(*) > {limit} AS degraded FROM p)"""


@query("bounded_families", f"WITH {CONTACTS_SQL}, {TUNNEL_SQL}, {ANSWERS_SQL}, {FLOWS_SQL}, {TLS_SQL} " + " UNION ALL ".join(map(_bounded_sql, _BOUNDED)))
def bounded_families(spark, sf_dir):
    frames = {"contacts": f.contacts, "tunnel": f.tunnel_queries, "answers": f.dns_answers, "flows": f.flows, "tls": f.tls}
    return capacity.bounded_frames({family: frames[frame](spark, sf_dir) for family, (frame, *_) in _BOUNDED.items()}, {family: limit for family, (_, _, limit, _) in _BOUNDED.items()})[1]


@query("bounded_novelty", f"""WITH RECURSIVE {CONTACTS_SQL},
 stop AS (SELECT f.epoch_s AS stop_s, f.event_id AS stop_id FROM (SELECT dst, min(struct_pack(epoch_s := epoch_s, event_id := event_id)) AS f FROM contacts GROUP BY 1) ORDER BY f OFFSET 60 LIMIT 1),
 s AS (SELECT dst, epoch_s, arg_min(src, event_id) AS src, arg_min(ts_iso, event_id) AS ts_iso FROM contacts
       WHERE NOT EXISTS (SELECT 1 FROM stop WHERE epoch_s > stop_s OR (epoch_s = stop_s AND event_id >= stop_id)) GROUP BY 1, 2),
 {_ANCHORS_SQL}
SELECT src, dst, epoch_s, ts_iso AS observed_at FROM a JOIN s USING (dst, epoch_s)""")
def bounded_novelty(spark, sf_dir):
    kept, _ = capacity.within_capacity(f.contacts(spark, sf_dir), ["dst"], 60)
    return d.first_seen_novelty(kept)
