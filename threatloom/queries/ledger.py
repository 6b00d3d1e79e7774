"""Ledger queries: orders stand for actions, parts for observables, events for audit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions.digest import sha_hex
from threatloom.functions.instants import iso_of, utc_literal
from threatloom.operators import evidence as ev
from threatloom.operators import ledger
from threatloom.plans import budgets
from threatloom.plans.policy import effective_adapter_mode
from threatloom.queries import frames as f
from threatloom.queries.decisions import POLICY
from threatloom.queries.frames import CONTACTS_SQL, EVIDENCE_SQL, INDICATORS_SQL, SOURCES_SQL, table
from threatloom.queries.registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_STATES = "'pending', 'dispatching', 'applied', 'verified', 'drifted', 'failed', 'expired', 'revoked', 'removing'"
NOW = "2000-06-01T00:00:00Z"


def actions(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").withColumn("day", day).selectExpr(
        "concat('a', o_orderkey) as action_id", "o_orderkey as seq", "concat('d', o_custkey) as decision_id", "concat('indicator--', o_custkey) as indicator_id",
        "element_at(array('zone', 'ids'), cast(o_orderkey % 2 + 1 as int)) as adapter", "concat('rule-', o_custkey % 400) as rule_id",
        "element_at(array('OFF', 'OBSERVE', 'SHADOW', 'ENFORCE'), cast(o_orderkey % 4 + 1 as int)) as mode",
        f"element_at(array({_STATES}), cast((o_orderkey + o_custkey) % 9 + 1 as int)) as state",
        "case when o_orderkey % 3 = 0 then 'ABSENT' else 'PRESENT' end as desired_state", "day as created_at",
        "case when o_orderkey % 5 > 0 then day + make_interval(0, 0, 0, cast(o_orderkey % 400 as int)) end as expires_at",
        "case when o_orderkey % 4 > 0 then day + make_interval(0, 0, 0, cast(o_orderkey % 90 as int)) end as verified_at",
        "case when o_orderkey % 6 > 0 then day + make_interval(0, 0, 0, cast(o_orderkey % 30 as int)) end as last_reconciled_at")


_ACTIONS = f"""act AS (SELECT 'a' || o_orderkey AS action_id, o_orderkey AS seq, 'd' || o_custkey AS decision_id, 'indicator--' || o_custkey AS indicator_id,
  ['zone', 'ids'][o_orderkey % 2 + 1] AS adapter, 'rule-' || (o_custkey % 400) AS rule_id, ['OFF', 'OBSERVE', 'SHADOW', 'ENFORCE'][o_orderkey % 4 + 1] AS mode,
  [{_STATES}][(o_orderkey + o_custkey) % 9 + 1] AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS desired_state, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) END AS expires_at, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 90 AS INT)) END AS verified_at,
  CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INT)) END AS last_reconciled_at FROM orders)"""
_T = "TIMESTAMP '2000-06-01 00:00:00'"
_INSTALLED = "('applied', 'verified', 'drifted')"


def _now():
    return utc_literal(NOW)


def _ids(df):
    return df.select("action_id", "state")


@query("actions_newest", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE state = 'verified' ORDER BY created_at DESC, seq DESC LIMIT 50")
def actions_newest(spark, sf_dir):
    return _ids(ledger.newest_first(actions(spark, sf_dir), ["created_at", "seq"], 50, F.col("state") == "verified"))


@query("actions_pending_oldest", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE state = 'pending' ORDER BY created_at, seq LIMIT 100")
def actions_pending_oldest(spark, sf_dir):
    return _ids(ledger.oldest_first(actions(spark, sf_dir), ["created_at", "seq"], F.col("state") == "pending", 100))


@query("actions_needing_verification", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE state IN {_INSTALLED} AND (verified_at IS NULL OR verified_at <= {_T}) ORDER BY created_at, seq LIMIT 100")
def actions_needing_verification(spark, sf_dir):
    return _ids(ledger.oldest_first(actions(spark, sf_dir), ["created_at", "seq"], ledger.needs_verification(_now()), 100))


@query("actions_due_for_expiry", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE state IN {_INSTALLED} AND expires_at <= {_T}")
def actions_due_for_expiry(spark, sf_dir):
    return _ids(actions(spark, sf_dir).where(ledger.due_for_expiry(_now())))


@query("actions_stuck", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE (state = 'dispatching' AND last_reconciled_at < {_T}) OR (state = 'removing' AND desired_state = 'ABSENT' AND (last_reconciled_at IS NULL OR last_reconciled_at < {_T}))")
def actions_stuck(spark, sf_dir):
    return _ids(ledger.oldest_first(actions(spark, sf_dir), [], ledger.stuck("dispatching", _now()) | ledger.stuck("removing", _now(), True)))


@query("actions_desired_absent", f"WITH {_ACTIONS} SELECT action_id, state FROM act WHERE desired_state = 'ABSENT' AND state IN ('applied', 'verified', 'drifted', 'removing')")
def actions_desired_absent(spark, sf_dir):
    return _ids(actions(spark, sf_dir).where(ledger.desired_absent()))


@query("actions_co_owned", f"WITH {_ACTIONS}, l AS (SELECT * FROM act WHERE state IN ('pending', 'dispatching', 'applied', 'verified', 'drifted')) "
       "SELECT action_id, state FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.adapter = a.adapter AND b.rule_id = a.rule_id AND b.mode = a.mode AND b.action_id <> a.action_id)")
def actions_co_owned(spark, sf_dir):
    return _ids(ledger.co_owned(actions(spark, sf_dir)))


@query("action_counts", f"WITH {_ACTIONS} SELECT state, count(*) AS n FROM act GROUP BY 1")
def action_counts(spark, sf_dir):
    return ledger.counts_by(actions(spark, sf_dir), "state")


@query("ledger_totals", f"WITH {_ACTIONS}, {SOURCES_SQL} SELECT (SELECT count(*) FROM act WHERE state IN ('pending', 'applied', 'verified', 'drifted')) AS live_actions, "
       "(SELECT count(*) FROM src) AS sources_registered, (SELECT count(*) FROM src WHERE enabled) AS sources_enabled")
def ledger_totals(spark, sf_dir):
    return ledger.ledger_totals(actions(spark, sf_dir), f.sources(spark, sf_dir))


@query("effective_adapter_modes", f"WITH {_ACTIONS} SELECT action_id, CASE WHEN mode IN ('SHADOW', 'ENFORCE') THEN 'SHADOW' ELSE mode END AS effective FROM act")
def effective_adapter_modes(spark, sf_dir):
    return actions(spark, sf_dir).select("action_id", effective_adapter_mode(F.lower("mode"), F.lit("SHADOW")).alias("effective"))


def decision_rows(spark, sf_dir):
    """Versions of decisions: one per order of a customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('d', o_custkey) as decision_id", "o_orderkey as seq", "concat('indicator--', o_custkey) as indicator_id",
        "element_at(array('NO_ACTION', 'OBSERVE', 'SHADOW_ACTION', 'AUTO_ENFORCE'), cast(o_orderkey % 4 + 1 as int)) as disposition",
        "case when o_custkey % 3 = 0 then 'sha-old' else 'sha-now' end as policy_content_sha256")


_DEC = """dec AS (SELECT 'd' || o_custkey AS decision_id, o_orderkey AS seq, 'indicator--' || o_custkey AS indicator_id,
  ['NO_ACTION', 'OBSERVE', 'SHADOW_ACTION', 'AUTO_ENFORCE'][o_orderkey % 4 + 1] AS disposition, CASE WHEN o_custkey % 3 = 0 THEN 'sha-old' ELSE 'sha-now' END AS policy_content_sha256 FROM orders),
latest AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY seq DESC) = 1)"""


@query("decisions_latest", f"WITH {_DEC} SELECT decision_id, seq, disposition FROM latest")
def decisions_latest(spark, sf_dir):
    return ledger.latest_per_key(decision_rows(spark, sf_dir), ["decision_id"], ["seq"]).select("decision_id", "seq", "disposition")


@query("decisions_newest", f"WITH {_DEC} SELECT decision_id, seq, disposition FROM dec WHERE disposition = 'AUTO_ENFORCE' ORDER BY seq DESC LIMIT 50")
def decisions_newest(spark, sf_dir):
    return ledger.newest_first(decision_rows(spark, sf_dir), ["seq"], 50, F.col("disposition") == "AUTO_ENFORCE").select("decision_id", "seq", "disposition")


@query("disposition_counts", f"WITH {_DEC} SELECT disposition, count(*) AS n FROM dec GROUP BY 1")
def disposition_counts(spark, sf_dir):
    return ledger.counts_by(decision_rows(spark, sf_dir), "disposition")


@query("explain_decisions", f"WITH {_DEC}, {EVIDENCE_SQL} SELECT decision_id, disposition, evidence_id, kind, source_id FROM latest LEFT JOIN evi USING (indicator_id)")
def explain_decisions(spark, sf_dir):
    latest = ledger.latest_per_key(decision_rows(spark, sf_dir), ["decision_id"], ["seq"])
    latest = latest.withColumns({"action": F.lit("none"), "rung": F.lit("NONE"), "reason_codes": F.array().cast("array<string>")})
    return ledger.explain_decisions(latest, f.evidence(spark, sf_dir)).select("decision_id", "disposition", "evidence_id", "kind", "source_id")


@query("current_policy", "SELECT 'v' || p_size AS policy_version, p_partkey AS revision FROM part WHERE p_size = 7 AND p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size = 7)")
def current_policy(spark, sf_dir):
    versions = table(spark, sf_dir, "part").selectExpr("concat('v', p_size) as policy_version", "p_partkey as revision", "'active' as status")
    current = versions.where("policy_version = 'v7'").groupBy("policy_version").agg(F.max("revision").alias("revision"))
    return ledger.current_policy(versions, current).select("policy_version", "revision")


@query("stale_authorizations", f"""WITH {_ACTIONS}, {_DEC}, {INDICATORS_SQL},
s AS (SELECT a.action_id, a.mode, i.value, i.itype, l.policy_content_sha256 AS h, l.decision_id AS d FROM act a LEFT JOIN ind i USING (indicator_id) LEFT JOIN latest l USING (decision_id)),
r AS (SELECT action_id, CASE WHEN value IS NULL THEN 'indicator_missing' WHEN d IS NULL THEN 'authorizing_decision_missing' WHEN h <> 'sha-now' THEN 'policy_revision_changed'
  WHEN mode = 'ENFORCE' THEN 'posture_not_permitted: persisted ENFORCE under current policy mode SHADOW'
  WHEN value IN ('p1.invalid', '198.51.100.0') THEN 'allowlisted_under_current_policy: allowlist_hit:' || value
  WHEN NOT CASE WHEN itype IN ('ipv4', 'cidr') THEN CAST(split_part(value, '.', 3) AS INT) BETWEEN 96 AND 111 ELSE value LIKE '%.invalid' END THEN 'target_out_of_scope_under_current_policy: ' || value END AS stale_reason FROM s)
SELECT * FROM r WHERE stale_reason IS NOT NULL""")
def stale_authorizations(spark, sf_dir):
    import dataclasses
    policy = dataclasses.replace(POLICY, mode="SHADOW", content_sha256="sha-now")
    latest = ledger.latest_per_key(decision_rows(spark, sf_dir), ["decision_id"], ["seq"])
    return budgets.stale_authorizations(actions(spark, sf_dir), f.indicators(spark, sf_dir), latest, policy).select("action_id", "stale_reason")


# --- idempotent writes -----------------------------------------------------------------------

@query("append_new_decisions", f"WITH {_DEC}, k AS (SELECT DISTINCT decision_id, disposition FROM dec WHERE seq % 5 = 0) "
       "SELECT DISTINCT decision_id, disposition FROM dec WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.decision_id = dec.decision_id AND k.disposition = dec.disposition)")
def append_new_decisions(spark, sf_dir):
    rows = decision_rows(spark, sf_dir)
    return ledger.new_rows(rows, rows.where("seq % 5 = 0"), ["decision_id", "disposition"]).select("decision_id", "disposition")


@query("observation_identities", f"""WITH {EVIDENCE_SQL}, h AS (SELECT indicator_id, sha256(concat_ws('|', kind, source_id, '', observed_at, '{{"client":"' || client || '"}}', '')) AS h FROM evi)
SELECT indicator_id, count(*) AS records, count(DISTINCT h) AS observations, min(h) AS first_hash FROM h GROUP BY 1""")
def observation_identities(spark, sf_dir):
    rows = f.evidence(spark, sf_dir)
    h = ev.observation_hash(F.col("kind"), F.col("source_id"), F.lit(None).cast("string"), F.col("observed_at"), F.create_map(F.lit("client"), F.col("client")), F.lit(None).cast("string"))
    return rows.select("indicator_id", h.alias("h")).groupBy("indicator_id").agg(
        F.count("*").alias("records"), F.count_distinct("h").alias("observations"), F.min("h").alias("first_hash"))


@query("observable_ids", f"WITH {INDICATORS_SQL} SELECT indicator_id, 'indicator--' || sha256(tenant_id || '|' || itype || '|' || CASE WHEN itype = 'fqdn' THEN lower(value) ELSE value END)[1:24] AS observable_id FROM ind")
def observable_ids(spark, sf_dir):
    return f.indicators(spark, sf_dir).select("indicator_id", ev.observable_id(F.col("itype"), F.col("value"), F.col("tenant_id")).alias("observable_id"))


def _sightings(spark, sf_dir):
    at = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").withColumn("day", iso_of(at)).selectExpr(
        "concat('p', l_partkey) as indicator_id", "'fqdn' as itype", "concat('p', l_partkey, '.invalid') as value", "array(l_returnflag) as tags",
        "case when l_linenumber % 2 = 0 then concat('t', l_suppkey % 3) end as tenant_id", "day as first_seen", "day as last_seen",
        "l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey as seq")


@query("upsert_indicators", """WITH s AS (SELECT 'p' || l_partkey AS indicator_id, l_returnflag AS tag, CASE WHEN l_linenumber % 2 = 0 THEN 't' || (l_suppkey % 3) END AS tenant_id,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS day, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS seq FROM lineitem)
SELECT indicator_id, (max(struct_pack(s := seq, t := tag))).t AS tag, (max(struct_pack(s := seq, t := tenant_id)) FILTER (tenant_id IS NOT NULL)).t AS tenant_id, min(day) AS first_seen, max(day) AS last_seen FROM s GROUP BY 1""")
def upsert_indicators(spark, sf_dir):
    rows = _sightings(spark, sf_dir)
    merged = ledger.upsert_indicators(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))
    return merged.select("indicator_id", F.array_join("tags", ";").alias("tag"), "tenant_id", "first_seen", "last_seen")


@query("merge_duplicate_observables", """WITH i AS (SELECT 'o' || p_partkey AS indicator_id, 'd' || (p_partkey % 300) || '.example' AS value, strftime(to_timestamp(p_partkey * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM part),
 k AS (SELECT value, arg_min(indicator_id, first_seen) AS keep_id FROM i GROUP BY 1), m AS (SELECT i.indicator_id, keep_id FROM i JOIN k USING (value)),
 r AS (SELECT DISTINCT keep_id, 'src-' || l_suppkey AS source_id FROM lineitem JOIN m ON m.indicator_id = 'o' || l_partkey)
SELECT keep_id AS indicator_id, count(*) AS source_refs FROM r GROUP BY 1""")
def merge_duplicate_observables(spark, sf_dir):
    inds = table(spark, sf_dir, "part").selectExpr(
        "concat('o', p_partkey) as indicator_id", "'fqdn' as itype", "concat('D', p_partkey % 300, '.example', case when p_partkey % 2 = 0 then '.' else '' end) as value",
        "date_format(timestamp_seconds(p_partkey * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as first_seen")
    refs = table(spark, sf_dir, "lineitem").selectExpr("concat('o', l_partkey) as indicator_id", "concat('src-', l_suppkey) as source_id")
    _, moved = ledger.merge_duplicates(inds, refs, ["indicator_id", "source_id"])
    return moved.groupBy("indicator_id").agg(F.count("*").alias("source_refs"))


@query("batch_outcome", "SELECT 'b' || o_custkey AS batch_id, o_orderstatus AS status FROM orders WHERE o_custkey = 7")
def batch_outcome(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").selectExpr("concat('b', o_custkey) as batch_id", "o_orderstatus as status")
    return ledger.batch_outcome(batches, "b7")


# --- audit chain -----------------------------------------------------------------------------

def audit_events(spark, sf_dir):
    """Events chained in pairs; every eleventh record was edited afterwards, every odd link after one is then broken."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(unix_seconds(cast(ts as timestamp)) as string) as at", "concat('u', user_id) as actor", "event_type", "props as subject", "'{}' as detail")
    lead = base.where("event_id % 2 = 0").withColumn("prev_hash", F.lit(None).cast("string"))
    lead = lead.withColumn("row_hash", ledger.audit_row_hash(F.col("prev_hash")))
    follow = base.where("event_id % 2 = 1").withColumn("_before", F.col("event_id") - 1) \
        .join(lead.select(F.col("event_id").alias("_before"), F.col("row_hash").alias("prev_hash")), "_before", "left").drop("_before")
    follow = follow.withColumn("row_hash", ledger.audit_row_hash(F.col("prev_hash")))
    return lead.unionByName(follow).withColumn("actor", F.when(F.col("event_id") % 11 == 5, "intruder").otherwise(F.col("actor")))


@query("audit_chain", "SELECT event_id, event_id % 11 = 5 AS hash_broken, event_id % 2 = 0 AND event_id > (SELECT min(event_id) FROM events) AS link_broken FROM events WHERE event_id % 11 = 5 OR (event_id % 2 = 0 AND event_id > (SELECT min(event_id) FROM events))")
def audit_chain(spark, sf_dir):
    return ledger.audit_breaks(audit_events(spark, sf_dir), chunk=1000)


# --- rule numbers ------------------------------------------------------------------------------

def probed_sql(wanted: str, taken: str) -> str:
    """CTEs up to ``probed(decision_id, base, rule_no, exhausted)`` from CTEs ``wanted(decision_id)`` and ``taken(rule_no, decision_id)``.

    Probing in preferred order is a running maximum over ranks of free numbers; an as-of join maps ranks back to numbers.
    """
    return f"""pw AS (SELECT decision_id, {ledger.RULE_BASE} + CAST('0x' || sha256(decision_id)[1:8] AS BIGINT) % {ledger.RULE_SPAN} AS base FROM {wanted}),
pk AS (SELECT decision_id, min(rule_no) AS rule_no FROM {taken} WHERE decision_id IS NOT NULL GROUP BY 1),
ph AS (SELECT rule_no, row_number() OVER (ORDER BY rule_no) AS nth FROM (SELECT DISTINCT rule_no FROM {taken})),
pf AS (SELECT w.decision_id, w.base, w.base - coalesce(ph.nth, 0) AS rank FROM (SELECT * FROM pw WHERE decision_id NOT IN (SELECT decision_id FROM pk)) w ASOF LEFT JOIN ph ON ph.rule_no < w.base),
pn AS (SELECT *, row_number() OVER (ORDER BY rank, decision_id) AS rn FROM pf),
ps AS (SELECT decision_id, base, rn + max(rank - rn) OVER (ORDER BY rn) AS slot FROM pn),
pm AS (SELECT ps.decision_id, ps.base, ps.slot + coalesce(h.nth, 0) AS rule_no FROM ps ASOF LEFT JOIN (SELECT rule_no - nth + 1 AS slot, max(nth) AS nth FROM ph GROUP BY 1) h ON h.slot <= ps.slot
  UNION ALL SELECT pw.decision_id, pw.base, pk.rule_no FROM pw JOIN pk USING (decision_id)),
probed AS (SELECT *, rule_no >= {ledger.RULE_BASE + ledger.RULE_SPAN} AS exhausted FROM pm)"""


@query("rule_numbers", f"""WITH rw AS (SELECT 'decision--' || sha256(CAST(o_orderkey AS VARCHAR))[1:24] AS decision_id FROM orders),
rt AS (SELECT {ledger.RULE_BASE} + p_partkey * 450 AS rule_no, CASE WHEN p_partkey % 3 = 0 THEN 'decision--' || sha256(CAST(p_partkey AS VARCHAR))[1:24] END AS decision_id FROM part),
{probed_sql("rw", "rt")} SELECT decision_id, base, rule_no, exhausted FROM probed""")
def rule_numbers(spark, sf_dir):
    """A third of the installed rules have an owner that may be compiled again."""
    def named(key):
        return F.concat(F.lit("decision--"), sha_hex(F.col(key).cast("string"), 24))

    decisions = table(spark, sf_dir, "orders").select(named("o_orderkey").alias("decision_id"))
    taken = table(spark, sf_dir, "part").select((F.lit(ledger.RULE_BASE) + F.col("p_partkey") * 450).alias("rule_no"), F.when(F.col("p_partkey") % 3 == 0, named("p_partkey")).alias("decision_id"))
    return ledger.rule_numbers(decisions, taken)


# --- attachment ----------------------------------------------------------------------------------

_KNOWN = "kn AS (SELECT 'indicator--' || p_partkey AS indicator_id, 'fqdn' AS itype, 'k' || (p_partkey % 75 * 2) || '.example' AS value, p_partkey AS pos FROM part)"


def known_names(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "concat('indicator--', p_partkey) as indicator_id", "'fqdn' as itype", "concat('k', p_partkey % 75 * 2, '.example') as value", "p_partkey as pos")


def _novel(spark, sf_dir):
    from threatloom.operators import detectors
    found = detectors.as_detections(detectors.first_seen_novelty(f.contacts(spark, sf_dir)), "first_seen_novelty")
    return detectors.detections_to_evidence(found)


_NOVEL_SQL = f"""{CONTACTS_SQL}, s AS (SELECT dst, epoch_s, arg_min(src, event_id) AS src, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2),
a AS (SELECT dst, min(epoch_s) AS epoch_s FROM s GROUP BY 1 UNION ALL SELECT s.dst, min(s.epoch_s) FROM a JOIN s ON s.dst = a.dst AND s.epoch_s > a.epoch_s + 86400 GROUP BY s.dst, a.epoch_s),
nv AS (SELECT dst AS target, epoch_s, src AS client, ts_iso AS observed_at FROM a JOIN s USING (dst, epoch_s))"""


@query("attach_detections", f"WITH RECURSIVE {_NOVEL_SQL}, {_KNOWN} SELECT indicator_id, target, 'behavioral_first_seen_novelty' AS kind, observed_at, client FROM nv JOIN kn ON kn.value = nv.target")
def attach_detections(spark, sf_dir):
    attached, _ = ev.attach_detections(_novel(spark, sf_dir), known_names(spark, sf_dir))
    return attached.select("indicator_id", "target", "kind", "observed_at", F.col("detail")["client"].alias("client"))


@query("pending_detections", f"WITH RECURSIVE {_NOVEL_SQL}, {_KNOWN} SELECT target, observed_at FROM nv WHERE target NOT IN (SELECT value FROM kn)")
def pending_detections(spark, sf_dir):
    return ev.attach_detections(_novel(spark, sf_dir), known_names(spark, sf_dir))[1].select("target", "observed_at")


@query("fold_address_detections", f"""WITH {_ACTIONS}, d AS (SELECT DISTINCT '10.0.0.' || (o_custkey % 40) AS target, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch_s, 'c' || o_custkey AS client FROM orders),
i AS (SELECT '10.0.0.' || (p_partkey % 60) AS target, arg_min('indicator--' || p_partkey, p_partkey) AS indicator_id FROM part GROUP BY 1),
r AS (SELECT d.*, indicator_id, row_number() OVER (PARTITION BY indicator_id ORDER BY epoch_s, client) AS rn FROM d JOIN i USING (target))
SELECT indicator_id, target, epoch_s, client FROM r WHERE rn + CAST(replace(target, '10.0.0.', '') AS INT) <= 100""")
def fold_address_detections(spark, sf_dir):
    detections = table(spark, sf_dir, "orders").selectExpr(
        "concat('10.0.0.', o_custkey % 40) as target", "unix_seconds(cast(o_orderdate as timestamp)) as epoch_s", "concat('c', o_custkey) as client").distinct() \
        .withColumn("kind", F.lit("behavioral_beacon_periodicity"))
    inds = table(spark, sf_dir, "part").selectExpr("concat('indicator--', p_partkey) as indicator_id", "'ipv4' as itype", "concat('10.0.0.', p_partkey % 60) as value", "p_partkey as pos")
    counts = inds.selectExpr("indicator_id", "pos % 60 as n_evidence")
    return ev.fold_detections(counts, detections, inds, cap=100).select("indicator_id", "target", "epoch_s", "client")
