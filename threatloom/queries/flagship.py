"""Telemetry to decisions in one query: detect, attach to known names, score, decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatloom.operators import detectors as d
from threatloom.operators import evidence as ev
from threatloom.plans.decide import decide
from threatloom.plans.policy import Policy
from threatloom.queries import frames as f
from threatloom.queries.decisions import FLAT_SQL, decided_sql, flat
from threatloom.queries.frames import CONTACTS_SQL, EVIDENCE_SQL, INDICATORS_SQL, SOURCES_SQL, table
from threatloom.queries.registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

POLICY = Policy(
    version="live-1", now="2024-01-20T00:00:00Z", mode="SHADOW", scope="tables", observe_m=20, rung_floors={"L1": (30, 0), "L2": (60, 0), "L4": (80, 0)},
    authorized_domains=("example",), recency_max_age_hours=24.0 * 7, randomization=True, bounds_version="rv-1", rotation_interval_s=86_400,
    ttl_jitter=(0.8, 1.0), nominal_rate_ceiling=240, rate_ceiling_jitter=(0.5, 1.0))

_SYNC = {"sync_window_s": 14_400, "min_hosts": 2, "chunk_s": 600}

_IND = "ind AS (SELECT 'indicator--' || p_partkey AS indicator_id, 'fqdn' AS itype, 'k' || p_partkey || '.example' AS value, 't' || (p_partkey % 4) AS tenant_id, 'b' || (p_partkey // 500) AS batch_id, p_partkey AS pos FROM part)"
_SRC = "src AS (SELECT 'local-behavioral' AS source_id, 'local' AS source_class, true AS independent, true AS auto_enforcement_allowed, CAST(NULL AS VARCHAR) AS upstream, true AS enabled)"
_EVI = f"""{CONTACTS_SQL}, s AS (SELECT dst, epoch_s, arg_min(src, event_id) AS src, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2),
a AS (SELECT dst, min(epoch_s) AS epoch_s FROM s GROUP BY 1 UNION ALL SELECT s.dst, min(s.epoch_s) FROM a JOIN s ON s.dst = a.dst AND s.epoch_s > a.epoch_s + 86400 GROUP BY s.dst, a.epoch_s),
n AS (SELECT c.dst, a.epoch_s AS anchor_s, c.src, c.event_id, c.epoch_s, c.ts_iso FROM contacts c JOIN a ON a.dst = c.dst AND c.epoch_s BETWEEN a.epoch_s AND a.epoch_s + 14400),
k AS (SELECT *, row_number() OVER (PARTITION BY dst, anchor_s, src ORDER BY epoch_s, event_id) = 1 AS is_new FROM n),
u AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY dst, anchor_s ORDER BY epoch_s, event_id) AS hosts FROM k),
dets AS (SELECT 'behavioral_first_seen_novelty' AS kind, src, dst, epoch_s, ts_iso FROM a JOIN s USING (dst, epoch_s) UNION ALL SELECT 'behavioral_sync_first_contact', '(population)', dst, epoch_s, ts_iso FROM u WHERE hosts >= 2),
evi AS (SELECT epoch_s * 2 + (kind = 'behavioral_sync_first_contact')::INT AS evidence_id, indicator_id, kind, 'local-behavioral' AS source_id, ts_iso AS observed_at, src AS client, CAST(NULL AS VARCHAR) AS protocol_class
  FROM dets JOIN (SELECT 'indicator--' || p_partkey AS indicator_id, 'k' || p_partkey || '.example' AS dst FROM part) USING (dst))"""
SQL = "WITH RECURSIVE " + decided_sql(POLICY).replace(INDICATORS_SQL, _IND).replace(SOURCES_SQL, _SRC).replace(EVIDENCE_SQL, _EVI).replace("'%.invalid'", "'%.example'") + f" SELECT {FLAT_SQL} FROM decided"


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('indicator--', p_partkey) as indicator_id", "'fqdn' as itype", "concat('k', p_partkey, '.example') as value",
        "concat('t', p_partkey % 4) as tenant_id", "concat('b', p_partkey div 500) as batch_id", "p_partkey as pos")


def local_source(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'local-behavioral' AS source_id, 'local' AS source_class, true AS independent, true AS auto_enforcement_allowed, cast(null AS string) AS upstream, true AS enabled")


@query("telemetry_to_decisions", SQL)
def telemetry_to_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = f.contacts(spark, sf_dir)
    found, _ = d.detect(["first_seen_novelty", "sync_first_contact"], dns_queries=contacts, options={"sync_first_contact": _SYNC})
    names = known_names(spark, sf_dir)
    attached, _ = ev.attach_detections(d.detections_to_evidence(found), names)
    evidence = attached.select(
        (F.col("epoch_s") * 2 + (F.col("kind") == "behavioral_sync_first_contact").cast("int")).alias("evidence_id"), "indicator_id", "kind", "source_id",
        "observed_at", F.col("detail")["client"].alias("client"), F.lit(None).cast("string").alias("protocol_class"))
    return flat(decide(names, evidence, local_source(spark), POLICY))
