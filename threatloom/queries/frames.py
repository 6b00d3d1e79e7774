"""Telemetry frames read from the shared tables, in Spark and as SQL.

Each ``X(spark, sf_dir)`` has a twin ``X_SQL`` with the same columns, so that an
operator and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatloom.functions.instants import iso_of, iso_of_epoch


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; with ``columns``, only those."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def _timed(df: DataFrame, ts: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return df.withColumn("epoch_s", F.unix_seconds(at)).withColumn("ts_iso", iso_of(at))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client-to-name contacts, also used as DNS queries."""
    return _timed(table(spark, sf_dir, "events"), "ts").selectExpr(
        "event_id", "concat('u', user_id % 50) as src", "concat('k', get_json_object(props, '$.k'), '.example') as dst",
        "case when event_id % 4 = 0 then 'TXT' when event_id % 4 = 1 then 'AAAA' else 'A' end as qtype", "ts_iso", "epoch_s")


CONTACTS_SQL = """contacts AS (
  SELECT event_id, 'u' || (user_id % 50) AS src, 'k' || json_extract_string(props, '$.k') || '.example' AS dst,
         CASE WHEN event_id % 4 = 0 THEN 'TXT' WHEN event_id % 4 = 1 THEN 'AAAA' ELSE 'A' END AS qtype,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s
  FROM events)"""


def tunnel_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS queries where odd events carry a long hashed label."""
    return _timed(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "ts").selectExpr(
        "event_id", "concat('u', user_id % 5) as src",
        "concat(case when event_id % 2 = 1 then substr(sha2(cast(event_id as string), 256), 1, 63) else 'www' end, '.t.example') as dst",
        "case when event_id % 3 = 0 then 'TXT' else 'A' end as qtype", "ts_iso", "epoch_s")


TUNNEL_SQL = """tunnel AS (
  SELECT event_id, 'u' || (user_id % 5) AS src,
         CASE WHEN event_id % 2 = 1 THEN substr(sha256(CAST(event_id AS VARCHAR)), 1, 63) ELSE 'www' END AS label,
         CASE WHEN event_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS qtype,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s
  FROM events)"""


def page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of fetched pages as DNS queries, page ids as seconds."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id as event_id", "concat('c', page_id % 7) as src",
        "lower(regexp_extract(url, 'https?://([^/:]+)', 1)) as dst", "'A' as qtype",
        "date_format(timestamp_seconds(page_id * 600), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts_iso",
        "page_id * 600 as epoch_s")


PAGES_SQL = """page_queries AS (
  SELECT page_id AS event_id, 'c' || (page_id % 7) AS src, lower(regexp_extract(url, 'https?://([^/:]+)', 1)) AS dst,
         strftime(to_timestamp(page_id * 600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts_iso,
         page_id * 600 AS epoch_s
  FROM pages)"""


def dns_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-to-supplier shipments as name-to-address answers."""
    return (
        _timed(table(spark, sf_dir, "lineitem"), "l_shipdate")
        .selectExpr("l_orderkey * 10 + l_linenumber as event_id", "concat('p', l_partkey) as domain",
                    "concat('10.0.', l_suppkey div 256, '.', l_suppkey % 256) as answer", "cast(l_quantity as bigint) as ttl",
                    "ts_iso", "epoch_s")
        .groupBy("event_id", "domain", "answer", "ts_iso", "epoch_s").agg(F.max("ttl").alias("ttl")))


ANSWERS_SQL = """answers AS (
  SELECT l_orderkey * 10 + l_linenumber AS event_id, 'p' || l_partkey AS domain,
         '10.0.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) AS answer, max(CAST(floor(l_quantity) AS BIGINT)) AS ttl,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS epoch_s
  FROM lineitem GROUP BY ALL)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as flows between supplier groups and part groups."""
    return (
        _timed(table(spark, sf_dir, "lineitem"), "l_shipdate")
        .selectExpr("l_orderkey * 10 + l_linenumber as event_id", "concat('s', l_suppkey % 20) as host",
                    "concat('p', l_partkey % 50) as dst", "cast(floor(l_extendedprice * 100) as bigint) as out_bytes",
                    "cast(floor(l_quantity * 4000) as bigint) as in_bytes", "ts_iso", "epoch_s")
        .groupBy("event_id", "host", "dst", "ts_iso", "epoch_s")
        .agg(F.sum("out_bytes").alias("out_bytes"), F.sum("in_bytes").alias("in_bytes")))


FLOWS_SQL = """flows AS (
  SELECT l_orderkey * 10 + l_linenumber AS event_id, 's' || (l_suppkey % 20) AS host, 'p' || (l_partkey % 50) AS dst,
         CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS out_bytes,
         CAST(sum(CAST(floor(l_quantity * 4000) AS BIGINT)) AS BIGINT) AS in_bytes,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS epoch_s
  FROM lineitem GROUP BY 1, 2, 3, 6, 7)"""


def tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(table(spark, sf_dir, "orders"), "o_orderdate").selectExpr(
        "o_orderkey as event_id", "concat('c', o_custkey) as client", "concat('d', o_orderkey % 97) as dst",
        "case when o_orderstatus <> 'F' then concat('d', o_orderkey % 97, '.example') end as sni",
        "substr(o_orderpriority, 1, 1) in ('1', '2') as cert_covers_sni", "o_orderkey % 3 = 0 as is_ip_https",
        "o_orderstatus <> 'F' as has_sni", "ts_iso", "epoch_s")


TLS_SQL = """tls AS (
  SELECT o_orderkey AS event_id, 'c' || o_custkey AS client, 'd' || (o_orderkey % 97) AS dst,
         CASE WHEN o_orderstatus <> 'F' THEN 'd' || (o_orderkey % 97) || '.example' END AS sni,
         substr(o_orderpriority, 1, 1) IN ('1', '2') AS cert_covers_sni, o_orderkey % 3 = 0 AS is_ip_https,
         o_orderstatus <> 'F' AS has_sni, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch_s
  FROM orders)"""


# --- indicators, evidence, registry ------------------------------------------------

KINDS = (
    "curated_source", "single_curated_source", "two_curated_sources", "contradictory_benign", "prior_false_positive",
    "direct_local_detection", "behavioral_beacon_periodicity", "behavioral_dga_likelihood", "behavioral_dns_tunneling",
    "behavioral_fastflux", "behavioral_volume_anomaly", "behavioral_first_seen_novelty", "behavioral_tls_metadata_mismatch",
    "behavioral_sync_first_contact", "exact_fqdn", "exact_ip", "exact_url", "recent", "bounded_scope", "verified_rollback",
    "dedicated_use", "dedicated_use_provenance", "exactness", "shared_cloud", "shared_cdn", "shared_hosting", "anonymizer",
    "fastflux_shared", "unlisted_kind",
)
_KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)

_ITYPE = "CASE WHEN p_partkey % 8 < 3 THEN 'fqdn' WHEN p_partkey % 8 < 6 THEN 'ipv4' WHEN p_partkey % 8 = 6 THEN 'cidr' ELSE 'url' END"
_VALUE = """CASE WHEN p_partkey % 8 < 3 THEN concat(CASE WHEN p_partkey % 50 = 0 THEN '*.' ELSE '' END, 'p', p_partkey,
      CASE WHEN p_partkey % 20 = 9 THEN '.example' ELSE '.invalid' END)
    WHEN p_partkey % 8 < 6 THEN concat('198.51.', 96 + p_partkey % 32, '.', {third})
    WHEN p_partkey % 8 = 6 THEN concat('198.51.', 96 + p_partkey % 32, '.0/24') ELSE concat('https://u', p_partkey, '.invalid') END"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observable per part, four tenants, batches of 500."""
    value = _VALUE.format(third="(p_partkey div 32) % 256")
    return table(spark, sf_dir, "part").selectExpr(
        "concat('indicator--', p_partkey) as indicator_id", f"{_ITYPE} as itype", f"{value} as value",
        "concat('t', p_partkey % 4) as tenant_id", "concat('b', p_partkey div 500) as batch_id", "p_partkey as pos")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('src-', s_suppkey) as source_id",
        "case when s_suppkey % 10 < 4 then 'curated' when s_suppkey % 10 < 7 then 'local' when s_suppkey % 10 = 7 then 'community' "
        "when s_suppkey % 10 = 8 then 'annotation' else 'attribution' end as source_class",
        "s_suppkey % 7 <> 0 as independent", "s_suppkey % 13 <> 0 as auto_enforcement_allowed",
        "case when s_suppkey % 3 = 0 then concat('up-', s_nationkey % 5) end as upstream", "s_suppkey % 17 <> 3 as enabled")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order line about a part."""
    rows = _timed(table(spark, sf_dir, "lineitem"), "l_shipdate").selectExpr(
        "l_orderkey * 10 + l_linenumber as evidence_id", "l_partkey",
        "cast((ascii(l_returnflag) + ascii(l_linestatus) * 3 + l_linenumber * 5 + cast(l_quantity as int)) % 29 as int) as kind_no",
        "l_suppkey", "epoch_s")
    # Numbers only, so that this is a hash aggregate over short rows; the text forms follow.
    rows = rows.groupBy("evidence_id", "l_partkey").agg(
        F.min("kind_no").alias("kind_no"), F.min("l_suppkey").alias("supplier"), F.min("epoch_s").alias("at")) \
        .withColumns({"indicator_id": F.concat(F.lit("indicator--"), F.col("l_partkey")), "observed_at": iso_of_epoch(F.col("at"))})
    return rows.selectExpr(
        "evidence_id", "indicator_id", f"element_at(array({_KIND_LIST}), kind_no + 1) as kind",
        "case when supplier % 11 = 5 then concat('ghost-', supplier) else concat('src-', supplier) end as source_id", "observed_at",
        "concat('c', evidence_id % 9) as client",
        "case when evidence_id % 4 = 0 then 'dns' when evidence_id % 4 = 1 then 'carrier-pigeon' else 'interactive_http' end as protocol_class")


INDICATORS_SQL = f"""ind AS (
  SELECT 'indicator--' || p_partkey AS indicator_id, {_ITYPE} AS itype, {_VALUE.format(third='(p_partkey // 32) % 256')} AS value,
         't' || (p_partkey % 4) AS tenant_id, 'b' || (p_partkey // 500) AS batch_id, p_partkey AS pos FROM part)"""
SOURCES_SQL = """src AS (
  SELECT 'src-' || s_suppkey AS source_id,
    CASE WHEN s_suppkey % 10 < 4 THEN 'curated' WHEN s_suppkey % 10 < 7 THEN 'local' WHEN s_suppkey % 10 = 7 THEN 'community'
         WHEN s_suppkey % 10 = 8 THEN 'annotation' ELSE 'attribution' END AS source_class,
    s_suppkey % 7 <> 0 AS independent, s_suppkey % 13 <> 0 AS auto_enforcement_allowed,
    CASE WHEN s_suppkey % 3 = 0 THEN 'up-' || (s_nationkey % 5) END AS upstream, s_suppkey % 17 <> 3 AS enabled FROM supplier)"""
EVIDENCE_SQL = f"""evi AS (
  SELECT evidence_id, indicator_id, ([{_KIND_LIST}])[kind_no + 1] AS kind,
    CASE WHEN supplier % 11 = 5 THEN 'ghost-' || supplier ELSE 'src-' || supplier END AS source_id, observed_at,
    'c' || (evidence_id % 9) AS client,
    CASE WHEN evidence_id % 4 = 0 THEN 'dns' WHEN evidence_id % 4 = 1 THEN 'carrier-pigeon' ELSE 'interactive_http' END AS protocol_class
  FROM (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, 'indicator--' || l_partkey AS indicator_id,
          min((ascii(l_returnflag) + ascii(l_linestatus) * 3 + l_linenumber * 5 + CAST(floor(l_quantity) AS INT)) % 29) AS kind_no,
          min(l_suppkey) AS supplier, min(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')) AS observed_at
        FROM lineitem GROUP BY 1, 2))"""
