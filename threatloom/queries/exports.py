"""Export queries: artifacts and exchange documents compiled from decisions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions.instants import utc_literal
from threatloom.queries import frames as f
from threatloom.queries.decisions import POLICY, decided_sql, decisions
from threatloom.queries.ledger import _ACTIONS, _DEC, actions, decision_rows, probed_sql
from threatloom.queries.frames import SOURCES_SQL, table
from threatloom.queries.registry import Registry
from threatloom.session import cut_lineage
from threatloom.sinks import artifacts, interop

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CLOCK = "2001-06-01T00:00:00Z"
_EXPORTABLE = "disposition IN ('SHADOW_ACTION', 'AUTO_ENFORCE', 'PROPOSE_OPERATOR_APPROVAL')"
_ZONE = f"""zn AS (SELECT decision_id, 'owner:' || value AS rule_id, value || ' IN CNAME . ; ' || decision_id || ' ' || disposition || ' policy=tables-1' AS fragment
  FROM decided WHERE itype = 'fqdn' AND action = 'dns_nxdomain' AND {_EXPORTABLE} AND NOT contains(value, '*')),
zf AS (SELECT *, 'frag--' || sha256(fragment)[1:24] AS fragment_hash FROM zn)"""
_RULES = f"""rl AS (SELECT decision_id, CASE WHEN itype = 'ipv4' THEN 'alert ip $HOME_NET any -> ' || value || ' any ' ELSE 'alert http any any -> any any ' END
  || '(msg:"response ' || disposition || ' ' || value || ' rung=' || rung || '"; ' || CASE WHEN itype = 'fqdn' THEN 'http.host; content:"' || value || '"; nocase; ' ELSE '' END
  || 'metadata:response_decision ' || decision_id || CASE WHEN action = 'rate_limit' THEN ', response_ceiling_per_min ' || rate_ceiling ELSE '' END
  || CASE WHEN itype = 'fqdn' THEN ', response_client ' || client ELSE '' END || ', response_ttl_seconds ' || greatest(1, ttl_seconds) || '; '
  || CASE WHEN action = 'rate_limit' THEN 'detection_filter:track by_src, count ' || rate_ceiling || ', seconds 60; ' ELSE '' END AS head
  FROM decided WHERE {_EXPORTABLE} AND ((itype = 'ipv4' AND action IN ('firewall_deny', 'rate_limit')) OR (itype = 'fqdn' AND action = 'rate_limit' AND NOT contains(value, '*'))))"""


def _decided(spark, sf_dir, policy=POLICY):
    # Exporters read decisions several times: compile from one materialised set.
    return cut_lineage(decisions(spark, sf_dir, policy))


def _taken(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("9100000 + p_partkey * 3 as rule_no")


@query("zone_lines", f"WITH {decided_sql()}, {_ZONE} SELECT decision_id, rule_id, fragment, fragment_hash FROM zf")
def zone_lines(spark, sf_dir):
    return artifacts.zone_fragments(_decided(spark, sf_dir), POLICY.authorized_domains).select("decision_id", "rule_id", "fragment", "fragment_hash")


@query("ids_rule_lines", f"""WITH {decided_sql()}, {_RULES}, et AS (SELECT 9100000 + p_partkey * 3 AS rule_no, CAST(NULL AS VARCHAR) AS decision_id FROM part), {probed_sql("rl", "et")}
SELECT decision_id, 'sid:' || rule_no AS rule_id, head || 'sid:' || rule_no || '; rev:1;)' AS fragment FROM rl JOIN probed USING (decision_id)""")
def ids_rule_lines(spark, sf_dir):
    rules = artifacts.rule_fragments(_decided(spark, sf_dir), _taken(spark, sf_dir))
    return rules.select("decision_id", "rule_id", "fragment")


@query("bundle_digests", f"""WITH {decided_sql()}, {_ZONE}, lv AS (SELECT fragment_hash[7:9] AS slot, count(*) AS n, sha256(string_agg(fragment_hash, chr(10) ORDER BY fragment_hash)) AS digest FROM zf GROUP BY 1)
SELECT 'zone-policy.invalid' AS bundle_id, CAST(sum(n) AS BIGINT) AS fragments, 'bundle--' || sha256(string_agg(digest, chr(10) ORDER BY slot))[1:24] AS bundle_hash FROM lv HAVING count(*) > 0""")
def bundle_digests(spark, sf_dir):
    return artifacts.bundle_digest(artifacts.zone_fragments(_decided(spark, sf_dir), POLICY.authorized_domains))


@query("receipts", f"WITH {decided_sql()}, {_ZONE} SELECT 'receipt--' || split_part(decision_id, '--', 2) || '-zone' AS receipt_id, decision_id, rule_id, fragment_hash FROM zf")
def receipts(spark, sf_dir):
    fragments = artifacts.zone_fragments(_decided(spark, sf_dir), POLICY.authorized_domains)
    return artifacts.receipts(fragments, CLOCK).select("receipt_id", "decision_id", "rule_id", "fragment_hash")


@query("materialization_gaps", f"""WITH {decided_sql()}, {_ZONE}, {_RULES}, u AS (SELECT * FROM decided WHERE {_EXPORTABLE} AND decision_id NOT IN (SELECT decision_id FROM zf UNION ALL SELECT decision_id FROM rl))
SELECT decision_id, array_to_string(CASE WHEN action = 'proxy_challenge' THEN ['no proxy actuator', 'selector shape not materializable: client_session']
  WHEN action = 'rate_limit' THEN ['no enforcing rate-limit actuator', 'selector shape not materializable: client_destination_pair'] WHEN action = 'firewall_deny' THEN ['no firewall actuator']
  ELSE ['no configured adapter accepts this action and type'] END, ';') AS gaps FROM u""")
def materialization_gaps(spark, sf_dir):
    made = _decided(spark, sf_dir)
    fragments = artifacts.zone_fragments(made, POLICY.authorized_domains).unionByName(artifacts.rule_fragments(made, _taken(spark, sf_dir)))
    wanted = made.where(F.col("disposition").isin(*artifacts.EXPORTABLE))
    return artifacts.materialization_gaps(wanted, fragments).select("decision_id", F.array_join("gaps", ";").alias("gaps"))


@query("artifact_drift", f"""WITH {decided_sql()}, {_ZONE}, pub AS (SELECT rule_id, CASE WHEN ascii(fragment_hash[7]) % 3 = 1 THEN 'other' ELSE fragment_hash END AS h FROM zf WHERE ascii(fragment_hash[7]) % 3 > 0
   UNION ALL SELECT 'owner:stray' || n_nationkey || '.invalid', 'x' FROM nation)
SELECT rule_id, CASE WHEN h IS NULL THEN 'missing' WHEN fragment_hash IS NULL THEN 'unexpected' ELSE 'changed' END AS drift FROM zf FULL JOIN pub USING (rule_id) WHERE h IS NULL OR fragment_hash IS NULL OR h <> fragment_hash""")
def artifact_drift(spark, sf_dir):
    desired = artifacts.zone_fragments(_decided(spark, sf_dir), POLICY.authorized_domains)
    state = F.ascii(F.substring("fragment_hash", 7, 1)) % 3
    lines = desired.where(state > 0).select(F.when(state == 1, F.concat("fragment", F.lit(" edited"))).otherwise(F.col("fragment")).alias("line")) \
        .unionByName(table(spark, sf_dir, "nation").selectExpr("concat('stray', n_nationkey, '.invalid IN CNAME . ; stray') as line"))
    return artifacts.artifact_drift(desired, lines, "zone")


@query("finding_events", f"""WITH {decided_sql()} SELECT decision_id, CASE WHEN maliciousness >= 90 THEN 7 WHEN maliciousness >= 75 THEN 6 WHEN maliciousness >= 50 THEN 5 WHEN maliciousness >= 25 THEN 4 WHEN maliciousness > 0 THEN 3 ELSE 1 END AS severity_id,
  '2001-06-01T00:00:00Z' AS event_time, 'decision ' || decision_id AS title, rung, len(string_split(reason_codes, ';')) - CASE WHEN reason_codes = '' THEN 1 ELSE 0 END AS tags, CASE WHEN scope_type IS NULL THEN 0 ELSE 3 + (protocol_class IS NOT NULL)::INT + (rate_ceiling IS NOT NULL)::INT END AS observables FROM decided""")
def finding_events(spark, sf_dir):
    body = F.from_json("body", "time string, finding struct<title:string>, unmapped struct<rung:string>, metadata_tags array<string>, observables array<struct<name:string>>")
    return interop.finding_events(decisions(spark, sf_dir), utc_literal(CLOCK)).withColumn("b", body).select(
        "decision_id", "severity_id", F.col("b.time").alias("event_time"), "b.finding.title", "b.unmapped.rung", F.size("b.metadata_tags").cast("long").alias("tags"), F.size("b.observables").cast("long").alias("observables"))


@query("response_commands", f"""WITH {decided_sql()} SELECT decision_id, CASE action WHEN 'proxy_challenge' THEN 'contain' WHEN 'none' THEN 'query' WHEN 'observe' THEN 'query' ELSE 'deny' END AS command,
  CASE WHEN scope_type IS NOT NULL THEN CASE WHEN contains(value, '/') OR contains(value, ':') THEN 'ipv4_connection' ELSE 'domain_name' END END AS target_kind,
  'openc2:actuator:' || CASE action WHEN 'proxy_challenge' THEN 'proxy-waf' WHEN 'rate_limit' THEN 'ips' WHEN 'dns_nxdomain' THEN 'dns-rpz' WHEN 'firewall_deny' THEN 'firewall' ELSE 'unknown' END || ':1.0' AS actuator,
  CASE WHEN ttl_seconds > 0 THEN strftime(TIMESTAMP '2001-06-01' + to_seconds(ttl_seconds), '%Y-%m-%dT%H:%M:%SZ') END AS stop_time FROM decided""")
def response_commands(spark, sf_dir):
    body = F.from_json("body", "actuator struct<type:string>, modifiers struct<stop_time:string>")
    return interop.commands(decisions(spark, sf_dir), utc_literal(CLOCK)).withColumn("b", body).select(
        "decision_id", "command", "target_kind", F.col("b.actuator.type").alias("actuator"), F.col("b.modifiers.stop_time").alias("stop_time"))


@query("response_playbooks", f"""WITH {decided_sql()} SELECT decision_id, 'playbook--' || sha256(decision_id)[1:16] AS playbook_id, CASE WHEN ttl_seconds > 0 THEN strftime(TIMESTAMP '2001-06-01' + to_seconds(ttl_seconds), '%Y-%m-%dT%H:%M:%SZ') END AS valid_until,
  CASE WHEN action IN ('none', 'observe') THEN 'observe' ELSE 'enforce' END AS enforce_step, CASE WHEN action NOT IN ('none', 'observe') THEN CASE WHEN scope_type IS NOT NULL THEN value ELSE indicator_id END END AS target, 'step--validate' AS after_observe FROM decided""")
def response_playbooks(spark, sf_dir):
    step = "struct<name:string,commands:array<struct<command:struct<target:string>>>,on_completion:array<struct<id:string>>>"
    body = F.from_json("body", f"steps struct<`step--observe`:{step},`step--enforce`:{step}>")
    return interop.playbooks(decisions(spark, sf_dir), utc_literal(CLOCK)).withColumn("b", body).select(
        "decision_id", "playbook_id", "valid_until", F.col("b.steps.`step--enforce`.name").alias("enforce_step"),
        F.try_element_at(F.col("b.steps.`step--enforce`.commands"), F.lit(1))["command"]["target"].alias("target"),
        F.try_element_at(F.col("b.steps.`step--observe`.on_completion"), F.lit(1))["id"].alias("after_observe"))


@query("kpi_rows", f"""WITH {_ACTIONS}, {_DEC}, {SOURCES_SQL}, st AS (SELECT unnest(['pending', 'dispatching', 'applied', 'verified', 'drifted', 'failed', 'expired', 'revoked']) AS s)
SELECT 'actions_' || s AS metric, '' AS labels, CAST((SELECT count(*) FROM act WHERE state = s) AS DOUBLE) AS value FROM st
UNION ALL SELECT 'decisions_total', '{{disposition="' || disposition || '"}}', CAST(count(*) AS DOUBLE) FROM dec GROUP BY disposition
UNION ALL SELECT 'sources_registered', '', CAST(count(*) AS DOUBLE) FROM src UNION ALL SELECT 'sources_enabled', '', CAST(count(*) FILTER (enabled) AS DOUBLE) FROM src""")
def kpi_rows(spark, sf_dir):
    return interop.kpi_rows(actions(spark, sf_dir), decision_rows(spark, sf_dir), f.sources(spark, sf_dir))
