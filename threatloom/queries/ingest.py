"""Source and canonicalisation queries: raw lines derived from the shared tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions import net, text
from threatloom.functions.instants import recency, times_agree, utc_literal
from threatloom.operators import evidence as ev
from threatloom.queries import frames as f
from threatloom.queries.detection import ENTROPY_SQL
from threatloom.queries.frames import EVIDENCE_SQL, table
from threatloom.queries.registry import Registry
from threatloom.sources import access_logs, contacts, eve, payloads, transactions

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


# --- contacts -------------------------------------------------------------------------

_CONTACT_LINE = """CASE event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat('{"src":', user_id, ',"dst":"d', k, '.example","ts_iso":"x","epoch_s":"', event_id, '"}')
  WHEN 2 THEN concat('{"src":"u","dst":"d","ts_iso":"x","epoch_s":', event_id, '.75}') WHEN 3 THEN concat('{"src":"u","ts_iso":"x","epoch_s":', event_id, '}')
  WHEN 4 THEN concat('{"src":"u","dst":"d","ts_iso":"x","epoch_s":"', event_id, '.5"}') WHEN 5 THEN concat('no object ', k)
  ELSE concat('{"src":"u', user_id, '","dst":"d', k, '.example","ts_iso":"t', k, '","epoch_s":', event_id, '}') END"""


@query("contact_records", """WITH c AS (SELECT event_id, event_id % 7 AS form, user_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE form WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 5 THEN NULL WHEN 6 THEN 'u' || user_id ELSE 'u' END AS src,
  CASE WHEN form IN (1, 6) THEN 'd' || k || '.example' WHEN form IN (2, 4) THEN 'd' END AS dst, CASE form WHEN 5 THEN NULL WHEN 6 THEN 't' || k ELSE 'x' END AS ts_iso,
  CASE WHEN form IN (1, 2, 3, 6) THEN event_id END AS epoch_s, CASE form WHEN 3 THEN 'dst' WHEN 4 THEN 'epoch_s' WHEN 5 THEN 'src' END AS problem FROM c WHERE form > 0""")
def contact_records(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "get_json_object(props, '$.k') as k").selectExpr("event_id", f"{_CONTACT_LINE} as line")
    return contacts.parse_contacts(lines)


# --- IDS events ---------------------------------------------------------------------

_STAMP = "date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
_EVE_LINE = f"""
  CASE WHEN event_id % 8 < 2 THEN concat('{{"timestamp":"', {_STAMP}, '+0000","event_type":"dns","src_ip":"10.0.0.', user_id % 250,
      '","dns":{{"type":"query","rrname":"k', k, '.example","rrtype":"TXT","answers":[{{"rrname":"x","rrtype":"A","rdata":"192.0.2.', k, '","ttl":', k * 3,
      '}},{{"rrtype":"CNAME","rdata":"alias"}},{{"rrtype":"aaaa","rdata":"2001:db8::', k, '","ttl":"60"}}]}}}}')
    WHEN event_id % 8 = 2 THEN concat('{{"timestamp":"', {_STAMP}, 'Z","event_type":"dns","src_ip":"10.0.0.', user_id % 250, '","rrname":"flat', k, '.example","rrtype":""}}')
    WHEN event_id % 8 = 3 THEN concat('{{"timestamp":"', {_STAMP}, '","event_type":"tls","src_ip":"10.0.0.', user_id % 250, '","dest_ip":"192.0.2.', k,
      '","tls":{{"sni":"k', k % 10, '.example","subject":"CN=k', k % 7, '.example"}}}}')
    WHEN event_id % 8 = 4 THEN concat('{{"timestamp":"', {_STAMP}, '+02:00","event_type":"tls","src_ip":"10.0.0.', user_id % 250, '","dest_ip":"',
      CASE WHEN k % 2 = 0 THEN '2001:db8::7' ELSE 'host.local' END, '","tls":{{}}}}')
    WHEN event_id % 8 = 5 THEN concat('{{"timestamp":"', {_STAMP}, 'Z","event_type":"flow","src_ip":"10.0.0.', user_id % 250, '","dest_ip":"192.0.2.', k,
      '","flow":{{"bytes_toserver":', event_id * 1000, CASE WHEN k % 2 = 0 THEN concat(',"bytes_toclient":"', k, '"') ELSE '' END, '}}}}')
    WHEN event_id % 8 = 6 THEN concat('{{"timestamp":"', {_STAMP}, 'Z","event_type":"alert","src_ip":"10.0.0.1"}}')
    WHEN event_id % 16 = 7 THEN 'not json at all' ELSE '{{"event_type":"dns","src_ip":"10.0.0.1","rrname":"undated.example"}}' END"""


def eve_parsed(spark, sf_dir):
    lines = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr("event_id", f"{_EVE_LINE} as line")
    return eve.parse_eve(lines)


_EV = """ev AS (SELECT event_id, '10.0.0.' || (user_id % 250) AS ip, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 8 AS slot,
  CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 8 = 4 THEN 7200 ELSE 0 END AS epoch_s FROM events),
e AS (SELECT *, strftime(to_timestamp(epoch_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts_iso FROM ev)"""


@query("eve_dns_queries", f"WITH {_EV} SELECT event_id, ip AS src, CASE WHEN slot = 2 THEN 'flat' ELSE 'k' END || k || '.example' AS dst, "
       "CASE WHEN slot < 2 THEN 'TXT' END AS qtype, ts_iso, epoch_s FROM e WHERE slot <= 2")
def eve_dns_queries(spark, sf_dir):
    return eve.dns_queries(eve_parsed(spark, sf_dir))


@query("eve_dns_answers", f"WITH {_EV} SELECT event_id, 'k' || k || '.example' AS domain, '192.0.2.' || k AS answer, CAST(k * 3 AS BIGINT) AS ttl, ts_iso, epoch_s FROM e WHERE slot < 2 "
       "UNION ALL SELECT event_id, 'k' || k || '.example', '2001:db8::' || k, 60, ts_iso, epoch_s FROM e WHERE slot < 2")
def eve_dns_answers(spark, sf_dir):
    return eve.dns_answers(eve_parsed(spark, sf_dir))


@query("eve_tls", f"WITH {_EV} SELECT event_id, ip AS client, CASE WHEN slot = 3 THEN 'k' || (k % 10) || '.example' WHEN k % 2 = 0 THEN '2001:db8::7' ELSE 'host.local' END AS dst, "
       "CASE WHEN slot = 3 THEN 'k' || (k % 10) || '.example' END AS sni, slot = 3 AND k % 10 = k % 7 AS cert_covers_sni, slot = 3 OR k % 2 = 0 AS is_ip_https, slot = 3 AS has_sni, "
       "ts_iso, epoch_s FROM e WHERE slot IN (3, 4)")
def eve_tls(spark, sf_dir):
    return eve.tls(eve_parsed(spark, sf_dir))


@query("eve_flows", f"WITH {_EV} SELECT event_id, ip AS host, '192.0.2.' || k AS dst, event_id * 1000 AS out_bytes, CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS BIGINT) AS in_bytes, "
       "ts_iso, epoch_s FROM e WHERE slot = 5")
def eve_flows(spark, sf_dir):
    return eve.flows(eve_parsed(spark, sf_dir))


@query("eve_line_counts", "SELECT count(*) AS lines_read, count(*) FILTER (event_id % 8 = 7) AS malformed_lines, count(*) FILTER (event_id % 8 = 6) AS unsupported_events FROM events")
def eve_line_counts(spark, sf_dir):
    return eve.line_counts(eve_parsed(spark, sf_dir))


@query("time_agreement", """WITH c AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 - 250 AS claimed,
  CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events) SELECT event_id, abs(claimed - epoch_s) <= 120 AS agrees FROM c""")
def time_agreement(spark, sf_dir):
    stated = table(spark, sf_dir, "events").selectExpr(
        "event_id", "unix_seconds(cast(ts as timestamp)) as epoch_s", "cast(get_json_object(props, '$.k') as bigint) * 5 - 250 as off") \
        .withColumn("ts_iso", F.date_format(F.timestamp_seconds(F.expr("epoch_s + off")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return stated.select("event_id", times_agree(F.col("ts_iso"), F.col("epoch_s")).alias("agrees"))


# --- access logs ----------------------------------------------------------------------

_DAY = "date_format(cast(o_orderdate as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_CLF = "date_format(cast(o_orderdate as timestamp), 'dd/MMM/yyyy:HH:mm:ss')"
_QUAD = "concat('198.51.', o_custkey % 200, '.', o_orderkey % 250)"
_LOG_LINE = f"""
  CASE WHEN o_orderkey % 5 = 0 THEN concat('[', {_DAY}, '] "GET /a HTTP/1.1" ', {_QUAD}, ':443 accept-language=en-', o_orderstatus,
      ' accept-encoding=gzip ja4=t13d', o_custkey % 9, ' ja4=t14d', o_custkey % 9)
    WHEN o_orderkey % 5 = 1 THEN concat('Jan  1 19:49:27 edge haproxy[312]: ', {_QUAD}, ':33890 [', {_CLF}, '.001] h=accept-language:', o_orderstatus, ' h=accept-encoding:identity')
    WHEN o_orderkey % 5 = 2 THEN concat('{{"time":"', {_DAY}, '","remote_addr":"[2001:0db8::', lower(hex(o_custkey + 1)), ']:443","http_accept_language":"', o_orderstatus,
      '","http_accept_encoding":5,"ssl_ja4":"q', o_custkey % 9, '","header_order":"host|accept|', o_orderstatus, '"}}')
    WHEN o_orderkey % 5 = 3 THEN concat('{{"time":"yesterday","remote_addr":"', {_QUAD}, '","header_order":"host|host"}}')
    ELSE concat('unrecognised line ', o_orderkey) END"""


def log_parsed(spark, sf_dir):
    return access_logs.parse_access_log(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").selectExpr("o_orderkey", f"{_LOG_LINE} as line"))


@query("access_log_records", """WITH o AS (SELECT *, o_orderkey % 5 AS slot, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day FROM orders)
SELECT o_orderkey, ['envoy', 'haproxy', 'nginx', 'nginx'][slot + 1] AS log_format, CASE WHEN slot < 3 THEN 'parsed' WHEN slot = 3 THEN 'rejected' ELSE 'unparsed' END AS outcome,
  CASE WHEN slot = 2 THEN '2001:db8::' || printf('%x', o_custkey + 1) WHEN slot < 4 THEN '198.51.' || (o_custkey % 200) || '.' || (o_orderkey % 250) END AS client_ref,
  CASE WHEN slot < 3 THEN day WHEN slot = 3 THEN 'yesterday' END AS observed_at,
  CASE WHEN slot = 0 THEN 'en-' || o_orderstatus WHEN slot < 3 THEN o_orderstatus END AS accept_language,
  CASE slot WHEN 0 THEN 'gzip' WHEN 1 THEN 'identity' END AS accept_encoding,
  CASE slot WHEN 0 THEN 't14d' || (o_custkey % 9) WHEN 2 THEN 'q' || (o_custkey % 9) END AS tls_ja4,
  CASE WHEN slot = 2 THEN 'host|accept|' || o_orderstatus END AS header_order FROM o""")
def access_log_records(spark, sf_dir):
    return log_parsed(spark, sf_dir).select(
        "o_orderkey", "log_format", "outcome", "client_ref", "observed_at", "accept_language", "accept_encoding", "tls_ja4",
        F.array_join("header_order", "|").alias("header_order"))


@query("access_log_counts", "SELECT count(*) FILTER (o_orderkey % 5 < 3) AS parsed, count(*) FILTER (o_orderkey % 5 = 3) AS rejected, count(*) FILTER (o_orderkey % 5 = 4) AS unparsed FROM orders")
def access_log_counts(spark, sf_dir):
    return access_logs.log_counts(log_parsed(spark, sf_dir))


# --- transactions -----------------------------------------------------------------------

_TX_LINE = f"""
  CASE WHEN o_orderkey % 10 = 9 THEN '{{"rejected":"bad"}}'
    ELSE concat('{{"client_ref":"c', o_custkey, '","observed_at":"', {_DAY}, '"',
      CASE WHEN o_orderkey % 10 = 1 THEN ',"tls_ja4":7' WHEN o_orderkey % 10 = 2 THEN ',"surprise":1' ELSE concat(',"tls_ja4":"j', o_orderstatus, '"') END,
      CASE WHEN o_orderkey % 10 = 3 THEN ',"cache_behavior":"odd"' ELSE ',"cache_behavior":"validators_absent"' END,
      CASE WHEN o_orderkey % 10 = 4 THEN ',"header_order":["a","a"]' WHEN o_orderkey % 10 = 5 THEN ',"header_order":"a"' ELSE concat(',"header_order":["host","', o_orderstatus, '"]') END, '}}') END"""


@query("transaction_contract", """SELECT o_orderkey, 'c' || o_custkey AS client_ref, CASE WHEN o_orderkey % 10 NOT IN (1, 2) THEN 'j' || o_orderstatus END AS tls_ja4,
  CASE o_orderkey % 10 WHEN 1 THEN 'tls_ja4 must be a string' WHEN 2 THEN 'unknown fields' WHEN 3 THEN 'cache_behavior must be one of validators_absent, validators_present_correct, validators_present_incorrect, revalidation_ignored'
    WHEN 4 THEN 'header_order must be a list of unique short strings (max 64)' WHEN 5 THEN 'header_order must be a list of unique short strings (max 64)' ELSE '' END AS violations
FROM orders WHERE o_orderkey % 10 <> 9""")
def transaction_contract(spark, sf_dir):
    parsed = transactions.parse_transactions(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").selectExpr("o_orderkey", f"{_TX_LINE} as line"))
    return parsed.select("o_orderkey", "client_ref", "tls_ja4", F.array_join("violations", ";").alias("violations"))


# --- indicator payloads ---------------------------------------------------------------------

def payload_rows(spark, sf_dir):
    """One payload per 25 parts; every seventh payload holds an invalid name."""
    items = table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 25 as g", "p_partkey as k", """named_struct(
          'id', concat('part-', p_partkey), 'type', element_at(array('fqdn', 'ipv4', 'cidr', 'url'), cast(p_partkey % 4 + 1 as int)),
          'value', case p_partkey % 4 when 0 then concat(' P', p_partkey, '.Example.COM. ') when 1 then concat('203.0.113.', p_partkey % 256)
              when 2 then concat('10.', p_partkey % 256, '.7.9/16') else case when p_partkey % 175 = 3 then 'http://bad url/' else concat('https://h/', p_partkey) end end,
          'sources', array(concat('chan-', p_partkey div 25)), 'tags', array(p_brand, 'x', 'x'),
          'last_seen', date_format(timestamp_seconds(p_partkey * 100), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
          'evidence', array(
            map('kind', 'curated_source', 'note', p_type, 'points_m', '100'),
            map('kind', concat('k', p_partkey % 3), 'source_id', case p_partkey % 3 when 0 then 'up-1' else 'stranger' end, 'observed_at', '2026-09-01T19:00:00Z'))) as item""".replace("p_brand,", "regexp_replace(p_brand, '#', '-'),"))
    return items.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json("item").alias("item")))), lambda x: x["item"]), ",").alias("items")) \
        .selectExpr("concat('{\"indicators\":[', items, ']}') as body", "concat('chan-', g) as channel", "array('up-1') as allowed_sources", "case when g % 2 = 0 then array('curated_source', 'k0') else array() end as allowed_kinds")


_BAD_G = "SELECT DISTINCT p_partkey // 25 AS g FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 175 = 3"


@query("payload_batches", f"WITH bad AS (SELECT g, count(*) AS n FROM (SELECT p_partkey // 25 AS g FROM part WHERE p_partkey % 4 = 3 AND p_partkey % 175 = 3) GROUP BY g) "
       "SELECT 'chan-' || (p_partkey // 25) AS channel, count(*) AS indicators, CAST(coalesce(any_value(n), 0) AS BIGINT) AS violations, any_value(n) IS NULL AS accepted "
       "FROM part LEFT JOIN bad ON g = p_partkey // 25 GROUP BY 1")
def payload_batches(spark, sf_dir):
    return payloads.payload_batches(payloads.parse_payloads(payload_rows(spark, sf_dir))).drop("batch_id", "raw_sha256")


@query("payload_indicators", f"""SELECT 'chan-' || (p_partkey // 25) AS channel, p_partkey % 25 AS pos, 'part-' || p_partkey AS source_object_id, ['fqdn', 'ipv4', 'cidr', 'url'][p_partkey % 4 + 1] AS itype,
  CASE p_partkey % 4 WHEN 0 THEN 'p' || p_partkey || '.example.com' WHEN 1 THEN '203.0.113.' || (p_partkey % 256) WHEN 2 THEN '10.' || (p_partkey % 256) || '.0.0/16' ELSE 'https://h/' || p_partkey END AS value,
  replace(p_brand, '#', '-') || ';x' AS tags FROM part WHERE p_partkey // 25 NOT IN ({_BAD_G})""")
def payload_indicators(spark, sf_dir):
    items = payloads.accepted_items(payloads.parse_payloads(payload_rows(spark, sf_dir)))
    return payloads.payload_indicators(items).select("channel", "pos", "source_object_id", "itype", "value", F.array_join("tags", ";").alias("tags"))


@query("payload_evidence", f"""WITH p AS (SELECT *, p_partkey // 25 AS g, p_partkey % 25 AS pos FROM part WHERE p_partkey // 25 NOT IN ({_BAD_G}))
SELECT 'chan-' || g AS channel_source, pos, 0 AS evidence_pos, 'curated_source' AS kind, 'chan-' || g AS source_id, strftime(to_timestamp(p_partkey * 100) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS observed_at,
  p_type AS note, 'note' AS detail_keys, false AS demoted FROM p
UNION ALL SELECT 'chan-' || g, pos, 1, 'k' || (p_partkey % 3), CASE WHEN p_partkey % 3 = 0 THEN 'up-1' ELSE 'unregistered' END, '2026-09-01T19:00:00Z', NULL, '',
  p_partkey % 3 <> 0 FROM p""")
def payload_evidence(spark, sf_dir):
    items = payloads.accepted_items(payloads.parse_payloads(payload_rows(spark, sf_dir)))
    return payloads.payload_evidence(items).select(
        "channel_source", "pos", "evidence_pos", "kind", "source_id", "observed_at", F.col("detail")["note"].alias("note"),
        F.array_join(F.array_sort(F.map_keys("detail")), ";").alias("detail_keys"), "demoted")


# --- canonical forms and scalar functions ------------------------------------------------------

@query("canonical_fqdn", r"""WITH p AS (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages),
 q AS (SELECT page_id, lower(regexp_replace(trim(host), '\.+$', '')) AS v FROM p)
SELECT page_id, CASE WHEN regexp_full_match(v, '[a-z0-9_-]+(\.[a-z0-9_-]+)*') AND length(v) <= 253 AND len(list_filter(string_split(v, '.'), lambda x: length(x) > 63)) = 0 THEN v END AS canonical FROM q""")
def canonical_fqdn(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_fqdn(F.regexp_extract("url", "https?://([^/]+)", 1)).alias("canonical"))


@query("canonical_url", r"""SELECT page_id, CASE WHEN NOT regexp_matches(trim(url), '[ \t\r\n;"\\]') AND length(trim(url)) <= 2048 THEN trim(url) END AS canonical FROM pages""")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("canonical_addresses", """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k, CASE WHEN k % 4 = 0 THEN '10.' || (k % 256) || '.0.' || (k // 256) WHEN k % 4 = 1 THEN NULL WHEN k % 4 = 2 THEN '2001:db8::' || printf('%x', k) ELSE NULL END AS address,
  CASE WHEN k % 4 = 3 THEN '172.16.' || (k % 256 - k % 256 % 16) || '.0/20' END AS network FROM c""")
def canonical_addresses(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", """case c_custkey % 4 when 0 then concat(' 10.', c_custkey % 256, '.0.', c_custkey div 256)
        when 1 then concat('010.', c_custkey % 256, '.1.1') when 2 then concat('2001:0DB8:0:0:0::', hex(c_custkey)) else concat('172.16.', c_custkey % 256, '.77/20') end as v""")
    return raw.select("k", net.canonical_ip(F.col("v")).alias("address"), net.canonical_cidr(F.when(F.col("v").contains("/"), F.col("v"))).alias("network"))


@query("client_addresses", """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '10.0.0.' || (c_custkey % 256) WHEN 1 THEN '2001:db8::1' WHEN 3 THEN '10.1.1.' || (c_custkey % 256) WHEN 4 THEN '2001:db8::' || printf('%x', c_custkey) END AS client FROM customer""")
def client_addresses(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", """case c_custkey % 6 when 0 then concat('10.0.0.', c_custkey % 256, ':5', c_custkey) when 1 then '[2001:0db8::1]:443'
        when 2 then 'fe80::1%eth0' when 3 then concat(' 10.1.1.', c_custkey % 256) when 4 then concat('2001:DB8::', hex(c_custkey)) else concat('host-', c_custkey) end as v""")
    return net.with_client_address(raw, "v", "client").select("k", "client")


@query("identifier_checks", r"""SELECT page_id, regexp_full_match(url, '[A-Za-z0-9_.:\-]{1,128}') AS id_ok, regexp_full_match(url, '[A-Za-z0-9_.\-/:]{1,128}') AS label_ok,
  regexp_full_match(regexp_extract(url, 'https?://([^/:]+)', 1), '[A-Za-z0-9_.:\-]{1,128}') AS client_ok, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_.:\-= ]', '_', 'g'), ''), '_') AS safe FROM pages""")
def identifier_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.valid_id(F.col("url")).alias("id_ok"), text.valid_label(F.col("url")).alias("label_ok"),
        text.valid_client(F.regexp_extract("url", "https?://([^/:]+)", 1)).alias("client_ok"), text.artifact_safe(F.col("url")).alias("safe"))


@query("strip_claimed_fields", "SELECT event_id, 'k;note' AS kept FROM events")
def strip_claimed_fields(spark, sf_dir):
    detail = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("points_m"), F.lit("100"), F.lit("family"), F.col("event_type"), F.lit("note"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(ev.strip_claims(detail))), ";").alias("kept"))


@query("evidence_recency", f"WITH {EVIDENCE_SQL} SELECT indicator_id, evidence_id, CASE WHEN epoch(TIMESTAMP '2001-06-01') - epoch(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ')) BETWEEN -300 AND 86400 * 90 THEN 'fresh' ELSE 'stale' END AS recency FROM evi")
def evidence_recency(spark, sf_dir):
    return f.evidence(spark, sf_dir).select("indicator_id", "evidence_id", recency(F.col("observed_at"), utc_literal("2001-06-01T00:00:00Z"), 24.0 * 90).alias("recency"))


@query("name_entropy", f"SELECT page_id, {ENTROPY_SQL.format(x='label')} AS entropy_microbits FROM "
       "(SELECT page_id, split_part(lower(regexp_extract(url, 'https?://([^/:]+)', 1)), '.', 1) AS label FROM pages)")
def name_entropy(spark, sf_dir):
    label = text.leftmost_label(F.lower(F.regexp_extract("url", "https?://([^/:]+)", 1)))
    return table(spark, sf_dir, "pages").select("page_id", text.entropy_microbits(label).alias("entropy_microbits"))
