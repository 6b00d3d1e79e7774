"""Population, coverage and outcome queries over the shared tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions.instants import utc_literal
from threatloom.operators import analytics as an
from threatloom.operators import detectors as d
from threatloom.operators import evidence as ev
from threatloom.operators import ledger
from threatloom.plans import budgets
from threatloom.plans.decide import canonical_key
from threatloom.queries import frames as f
from threatloom.queries.decisions import POLICY, _inputs, decide, decided_sql
from threatloom.queries.frames import CONTACTS_SQL, EVIDENCE_SQL, FLOWS_SQL, INDICATORS_SQL, SOURCES_SQL, TLS_SQL, table
from threatloom.queries.ledger import NOW, _ACTIONS, actions
from threatloom.queries.registry import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_T0 = 959_817_600  # 2000-06-01T00:00:00Z


@query("scope_by_domain_list", f"WITH {INDICATORS_SQL}, dl AS (SELECT DISTINCT 'p' || (p_partkey * 3) || '.invalid' AS domain FROM part UNION SELECT 'example') "
       "SELECT indicator_id, EXISTS (SELECT 1 FROM dl WHERE ind.value = dl.domain OR ends_with(ind.value, '.' || dl.domain)) AS in_scope FROM ind WHERE itype = 'fqdn'")
def scope_by_domain_list(spark, sf_dir):
    domains = table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey * 3, '.INVALID.') as domain").union(spark.sql("select 'example'"))
    return an.scoped_names(f.indicators(spark, sf_dir).where("itype = 'fqdn'").select("indicator_id", "value"), domains).select("indicator_id", "in_scope")


_PREFIXES = """px AS (SELECT '198.51.' || (96 + s_suppkey % 32) || '.' || (s_suppkey % 4 * 64) || '/26' AS prefix, 'vpn' AS infra_class, s_suppkey AS version, 26 AS bits FROM supplier
  UNION ALL SELECT '198.51.' || (96 + n_nationkey % 32) || '.0/24', ['cdn', 'hyperscaler', 'hosting', 'dedicated', 'tor'][n_nationkey % 5 + 1], n_nationkey, 24 FROM nation)"""


def class_registry(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("concat('198.51.', 96 + s_suppkey % 32, '.', s_suppkey % 4 * 64, '/26') as prefix", "'vpn' as infra_class", "s_suppkey as version").unionByName(
        table(spark, sf_dir, "nation").selectExpr("concat('198.51.', 96 + n_nationkey % 32, '.0/24') as prefix",
                                                  "element_at(array('cdn', 'hyperscaler', 'hosting', 'dedicated', 'tor'), n_nationkey % 5 + 1) as infra_class", "cast(n_nationkey as bigint) as version"))


@query("infrastructure_classes", f"""WITH {INDICATORS_SQL}, {_PREFIXES}, h AS (SELECT i.indicator_id, i.value AS address, px.* FROM ind i JOIN px ON i.itype = 'ipv4'
   AND split_part(i.value, '.', 3) = split_part(px.prefix, '.', 3) AND (bits = 24 OR CAST(split_part(i.value, '.', 4) AS INT) // 64 = CAST(split_part(split_part(px.prefix, '.', 4), '/', 1) AS INT) // 64)),
 b AS (SELECT indicator_id, address, max(struct_pack(bits := bits, c := infra_class, p := prefix, v := version)) AS b FROM h GROUP BY 1, 2)
SELECT indicator_id, address, b.c AS infra_class, b.p AS prefix, b.v AS version, CASE b.c WHEN 'cdn' THEN 'shared_cdn' WHEN 'hyperscaler' THEN 'shared_cloud' WHEN 'hosting' THEN 'shared_hosting' WHEN 'vpn' THEN 'anonymizer' WHEN 'dedicated' THEN 'dedicated_use_provenance' END AS kind FROM b""")
def infrastructure_classes(spark, sf_dir):
    addresses = f.indicators(spark, sf_dir).where("itype = 'ipv4'").selectExpr("indicator_id", "value as address")
    return an.infrastructure_evidence(addresses, class_registry(spark, sf_dir), [24, 26])


@query("allowlist_by_table", f"""WITH {INDICATORS_SQL}, al AS (SELECT p_partkey AS pos, 'p' || (p_partkey % 700) || '.invalid' AS canonical, CASE WHEN p_partkey % 3 = 0 THEN '*' WHEN p_partkey % 3 = 1 THEN 'tables' ELSE 'other' END AS scope,
   CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2001-01-01T00:00:00Z' WHEN 2 THEN 'someday' ELSE '2030-01-01T00:00:00Z' END AS expires_at FROM part),
 f AS (SELECT canonical, arg_min(coalesce(expires_at, '-'), pos) AS e FROM al WHERE scope IN ('*', 'tables') AND (expires_at IS NULL OR expires_at <> '2001-01-01T00:00:00Z') GROUP BY 1)
SELECT indicator_id, e IS NOT NULL AND e <> 'someday' AS allowlisted, CASE WHEN e = 'someday' THEN 'allowlist_unparsable_expiry:' || value WHEN e IS NOT NULL THEN 'allowlist_hit:' || value END AS allow_reason
FROM ind LEFT JOIN f ON f.canonical = lower(value)""")
def allowlist_by_table(spark, sf_dir):
    entries = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pos", "concat('p', p_partkey % 700, '.invalid') as canonical", "case p_partkey % 3 when 0 then '*' when 1 then 'tables' else 'other' end as scope",
        "case p_partkey % 4 when 1 then '2001-01-01T00:00:00Z' when 2 then 'someday' when 3 then '2030-01-01T00:00:00Z' end as expires_at")
    values = f.indicators(spark, sf_dir).withColumn("allow_key", canonical_key(F.col("value")))
    return an.allowlist_matches(values, entries, "tables", POLICY.now).select("indicator_id", "allowlisted", "allow_reason")


def _segmented(spark, sf_dir):
    return f.contacts(spark, sf_dir).where("event_id % 2 = 0").selectExpr("src as host", "dst", "epoch_s", "concat('seg-', event_id % 7) as segment")


@query("coverage_ledger", f"""WITH {CONTACTS_SQL}, fl AS (SELECT src AS host, epoch_s, 'seg-' || (event_id % 7) AS segment FROM contacts WHERE event_id % 2 = 0), q AS (SELECT src AS host, epoch_s FROM contacts WHERE event_id % 2 = 1),
 c AS (SELECT segment, EXISTS (SELECT 1 FROM q WHERE q.host = fl.host AND q.epoch_s BETWEEN fl.epoch_s - 7200 AND fl.epoch_s) AS covered FROM fl)
SELECT segment, count(*) AS sessions, count(*) FILTER (covered) AS dns_bearing, count(*) FILTER (covered) * 1000000 // count(*) AS coverage_micros, count(*) FILTER (covered) * 1000000 // count(*) < 300000 AS below_floor FROM c GROUP BY 1""")
def coverage_ledger(spark, sf_dir):
    queries = f.contacts(spark, sf_dir).where("event_id % 2 = 1").selectExpr("src as host", "epoch_s")
    return an.coverage_ledger(_segmented(spark, sf_dir), queries, 7200, 300_000)


@query("allowlist_simulation", f"WITH {FLOWS_SQL} SELECT dst, count(*) AS flows, count(DISTINCT host) AS hosts, CAST(sum(out_bytes) AS BIGINT) AS denied_bytes FROM flows WHERE dst NOT IN (SELECT 'p' || (p_size % 20) FROM part) GROUP BY 1")
def allowlist_simulation(spark, sf_dir):
    allowed = table(spark, sf_dir, "part").selectExpr("concat('p', p_size % 20) as dst")
    return an.allowlist_simulation(f.flows(spark, sf_dir), allowed, ["dst"])


_PER = f"{FLOWS_SQL}, pr AS (SELECT dst, epoch_s // 86400 AS period, CAST(sum(out_bytes) AS BIGINT) AS bytes FROM flows GROUP BY 1, 2), bd AS (SELECT dst, count(*) AS periods, quantile_disc(bytes, 0.05) AS low_bytes, quantile_disc(bytes, 0.95) AS high_bytes FROM pr GROUP BY 1)"


@query("traffic_profiles", f"WITH {_PER} SELECT dst, periods, low_bytes, high_bytes, peers FROM bd JOIN (SELECT dst, count(DISTINCT host) AS peers FROM flows GROUP BY 1) USING (dst)")
def traffic_profiles(spark, sf_dir):
    return an.traffic_profiles(f.flows(spark, sf_dir), 86_400)


@query("profile_drift", f"WITH {_PER} SELECT dst, period, bytes, CASE WHEN bytes > high_bytes THEN 'above' ELSE 'below' END AS drift FROM pr JOIN bd USING (dst) WHERE bytes > high_bytes OR bytes < low_bytes")
def profile_drift(spark, sf_dir):
    return an.profile_drift(f.flows(spark, sf_dir), an.traffic_profiles(f.flows(spark, sf_dir), 86_400), 86_400)


def _suite(spark, sf_dir):
    return d.detect(["first_seen_novelty", "tls_metadata_mismatch", "made_up_family"], dns_queries=f.contacts(spark, sf_dir), tls=f.tls(spark, sf_dir))


_SUITE = f"""{CONTACTS_SQL}, {TLS_SQL}, s AS (SELECT dst, epoch_s, arg_min(src, event_id) AS src, arg_min(ts_iso, event_id) AS ts_iso FROM contacts GROUP BY 1, 2),
a AS (SELECT dst, min(epoch_s) AS epoch_s FROM s GROUP BY 1 UNION ALL SELECT s.dst, min(s.epoch_s) FROM a JOIN s ON s.dst = a.dst AND s.epoch_s > a.epoch_s + 86400 GROUP BY s.dst, a.epoch_s),
de AS (SELECT 'behavioral_first_seen_novelty' AS kind, src, dst, epoch_s, ts_iso AS observed_at FROM a JOIN s USING (dst, epoch_s)
  UNION ALL SELECT 'behavioral_tls_metadata_mismatch', client, dst, epoch_s, ts_iso FROM tls WHERE (sni <> '' AND NOT cert_covers_sni) OR (is_ip_https AND NOT has_sni))"""


@query("detector_suite", f"WITH RECURSIVE {_SUITE} SELECT * FROM de")
def detector_suite(spark, sf_dir):
    found, unknown = _suite(spark, sf_dir)
    assert unknown == ["made_up_family"]
    return found.select("kind", "src", "dst", "epoch_s", "observed_at")


@query("newest_detections", f"WITH RECURSIVE {_SUITE} SELECT * FROM de ORDER BY epoch_s DESC, kind, dst, src LIMIT 500")
def newest_detections(spark, sf_dir):
    return d.newest(_suite(spark, sf_dir)[0], 500).select("kind", "src", "dst", "epoch_s", "observed_at")


@query("detector_health", f"""WITH RECURSIVE {_SUITE}, n AS (SELECT kind, count(*) AS detections FROM de GROUP BY 1)
SELECT 'behavioral_first_seen_novelty' AS kind, (SELECT count(*) FROM contacts) AS events_seen, 0 AS rejected, (SELECT count(DISTINCT dst) FROM contacts) AS tracked_keys, (SELECT detections FROM n WHERE kind = 'behavioral_first_seen_novelty') AS detections
UNION ALL SELECT 'behavioral_tls_metadata_mismatch', (SELECT count(*) FROM tls), 0, (SELECT count(*) FROM (SELECT DISTINCT client, dst FROM tls)), (SELECT detections FROM n WHERE kind = 'behavioral_tls_metadata_mismatch')""")
def detector_health(spark, sf_dir):
    frames = {"first_seen_novelty": f.contacts(spark, sf_dir), "tls_metadata_mismatch": f.tls(spark, sf_dir)}
    return d.detector_health(frames, {"first_seen_novelty": ["dst"], "tls_metadata_mismatch": ["client", "dst"]}, _suite(spark, sf_dir)[0])


@query("host_clusters", f"WITH RECURSIVE {_SUITE} SELECT src, count(DISTINCT kind) AS families, count(*) AS detections, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds FROM "
       "(SELECT kind, regexp_replace(src, '^[uc]', 'h') AS src FROM de) GROUP BY 1 HAVING count(DISTINCT kind) >= 2")
def host_clusters(spark, sf_dir):
    found = _suite(spark, sf_dir)[0].withColumn("src", F.regexp_replace("src", "^[uc]", "h"))
    return an.host_clusters(found)


@query("temporal_concurrence", f"""WITH {EVIDENCE_SQL}, {SOURCES_SQL}, p AS (SELECT DISTINCT indicator_id, coalesce(upstream, source_id) AS identity, CAST(epoch(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS epoch_s FROM evi JOIN src USING (source_id)),
 c AS (SELECT a.indicator_id, a.epoch_s, count(DISTINCT b.identity) AS sources FROM (SELECT DISTINCT indicator_id, epoch_s FROM p) a JOIN p b ON b.indicator_id = a.indicator_id AND b.epoch_s BETWEEN a.epoch_s - 8640000 AND a.epoch_s GROUP BY 1, 2)
SELECT indicator_id, max(sources) AS sources, (min(struct_pack(n := -sources, at := epoch_s))).at AS reached_s FROM c GROUP BY 1 HAVING max(sources) >= 3""")
def temporal_concurrence(spark, sf_dir):
    proven = ev.with_provenance(f.evidence(spark, sf_dir), f.sources(spark, sf_dir)).where("source_class <> 'unregistered'")
    sightings = proven.select("indicator_id", "identity", F.unix_seconds(F.to_timestamp("observed_at")).alias("epoch_s"))
    return an.temporal_concurrence(sightings, 8_640_000, 3)


@query("local_prevalence", f"WITH {CONTACTS_SQL} SELECT 't' || (event_id % 3) AS tenant_id, dst, count(DISTINCT src) AS clients, count(*) AS contacts, min(epoch_s) AS first_s, max(epoch_s) AS last_s FROM contacts GROUP BY 1, 2")
def local_prevalence(spark, sf_dir):
    return an.local_prevalence(f.contacts(spark, sf_dir).withColumn("tenant_id", F.expr("concat('t', event_id % 3)")))


@query("certificate_clusters", "SELECT sha256(CAST(o_custkey // 3 AS VARCHAR)) AS fingerprint, count(DISTINCT 'd' || (o_orderkey % 97)) AS names, count(DISTINCT o_custkey) AS addresses, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS not_before FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 97) >= 20")
def certificate_clusters(spark, sf_dir):
    certs = table(spark, sf_dir, "orders").selectExpr(
        "sha2(cast(o_custkey div 3 as string), 256) as fingerprint", "concat('d', o_orderkey % 97) as name", "o_custkey as address", "date_format(cast(o_orderdate as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as not_before")
    return an.certificate_clusters(certs, 20)


@query("nxdomain_bursts", f"""WITH {CONTACTS_SQL}, w AS (SELECT src, event_id % 3 = 0 AS nx, unnest([epoch_s // 3600 * 3600, epoch_s // 3600 * 3600 - 3600]) AS start_s FROM contacts),
 g AS (SELECT src, start_s, count(*) AS queries, count(*) FILTER (nx) AS nx FROM w GROUP BY 1, 2)
SELECT src, start_s, queries, nx, nx * 1000000 // queries AS nx_micros FROM g WHERE queries >= 3 AND nx * 1000000 // queries >= 500000""")
def nxdomain_bursts(spark, sf_dir):
    return an.nxdomain_bursts(f.contacts(spark, sf_dir).withColumn("nxdomain", F.expr("event_id % 3 = 0")), "2 hours", "1 hour", 3)


@query("young_domains", f"""WITH {CONTACTS_SQL}, r AS (SELECT 'k' || p_partkey || '.example' AS dst, 1704067200 + p_partkey * 20000 AS registered_s FROM part)
SELECT dst, (epoch_s - registered_s) // 86400 AS age_days, count(*) AS contacts, count(DISTINCT src) AS clients FROM contacts JOIN r USING (dst) WHERE epoch_s >= registered_s AND (epoch_s - registered_s) // 86400 <= 10 GROUP BY 1, 2""")
def young_domains(spark, sf_dir):
    # ``div`` rounds toward zero: contacts less than a day before registration must not count as age 0.
    regs = table(spark, sf_dir, "part").selectExpr("concat('k', p_partkey, '.example') as dst", "1704067200 + p_partkey * 20000 as registered_s")
    return an.young_domains(f.contacts(spark, sf_dir), regs, 10)


@query("blast_radius", f"""WITH {CONTACTS_SQL}, c AS (SELECT dst AS value, count(DISTINCT src) AS clients, count(DISTINCT event_id % 3) AS tenants, count(*) AS contacts FROM contacts GROUP BY 1)
SELECT 'i' || p_partkey AS indicator_id, 'k' || p_partkey || '.example' AS value, coalesce(clients, 0) AS clients, coalesce(tenants, 0) AS tenants, coalesce(contacts, 0) AS contacts, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes
FROM part LEFT JOIN c ON c.value = 'k' || p_partkey || '.example' LEFT JOIN (SELECT 'k' || (l_partkey % 200) || '.example' AS v, sum(CAST(floor(l_quantity) AS BIGINT)) AS bytes FROM lineitem GROUP BY 1) ON v = 'k' || p_partkey || '.example'""")
def blast_radius(spark, sf_dir):
    inds = table(spark, sf_dir, "part").selectExpr("concat('i', p_partkey) as indicator_id", "concat('k', p_partkey, '.example') as value")
    flows = table(spark, sf_dir, "lineitem").selectExpr("concat('k', l_partkey % 200, '.example') as dst", "cast(l_quantity as bigint) as out_bytes")
    return an.blast_radius(inds, f.contacts(spark, sf_dir).withColumn("tenant_id", F.expr("concat('t', event_id % 3)")), flows)


_SPANS = """sp AS (SELECT 'a' || p_partkey AS action_id, 'k' || (p_partkey % 120) || '.example' AS target, 1704067200 + p_partkey * 997 AS start_s,
  CASE WHEN p_partkey % 6 > 0 THEN 1704067200 + p_partkey * 997 + p_partkey % 50 * 20000 END AS end_s FROM part)"""


def spans(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("concat('a', p_partkey) as action_id", "concat('k', p_partkey % 120, '.example') as target", "1704067200 + p_partkey * 997 as start_s",
                                                   "case when p_partkey % 6 > 0 then 1704067200 + p_partkey * 997 + p_partkey % 50 * 20000 end as end_s")


@query("outcome_feedback", f"""WITH {CONTACTS_SQL}, {_SPANS}, m AS (SELECT action_id, count(*) AS n FROM sp JOIN contacts ON dst = target AND epoch_s >= start_s AND (end_s IS NULL OR epoch_s < end_s) GROUP BY 1),
 r AS (SELECT 'a' || (o_custkey * 3) AS action_id, count(*) AS n FROM orders GROUP BY 1)
SELECT action_id, target, coalesce(m.n, 0) AS matches, coalesce(end_s <= 1705000000, false) AS expired, coalesce(r.n, 0) AS false_positive_reports FROM sp LEFT JOIN m USING (action_id) LEFT JOIN r USING (action_id)""")
def outcome_feedback(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").selectExpr("concat('a', o_custkey * 3) as action_id")
    return an.outcome_feedback(spans(spark, sf_dir), f.contacts(spark, sf_dir), reports, 1_705_000_000)


@query("shadow_matches", f"""WITH {CONTACTS_SQL}, {_SPANS}, m AS (SELECT action_id, count(*) AS n FROM sp JOIN contacts ON dst = target AND epoch_s >= start_s AND (end_s IS NULL OR epoch_s < end_s) GROUP BY 1)
SELECT action_id AS decision_id, target, coalesce(m.n, 0) AS would_match, target IN (SELECT 'k' || n_nationkey || '.example' FROM nation) AS legitimate FROM sp LEFT JOIN m USING (action_id)""")
def shadow_matches(spark, sf_dir):
    legit = table(spark, sf_dir, "nation").selectExpr("concat('k', n_nationkey, '.example') as target")
    return an.shadow_matches(spans(spark, sf_dir).withColumnRenamed("action_id", "decision_id"), f.contacts(spark, sf_dir), legit)


@query("exposure_drift", "SELECT 'h' || l_suppkey AS host, 8000 + l_linenumber AS port, count(*) AS sightings, CAST(min(epoch(l_shipdate)) AS BIGINT) AS first_s FROM lineitem WHERE l_linenumber > 3 OR (l_linenumber = 2 AND l_suppkey % 4 = 0) GROUP BY 1, 2")
def exposure_drift(spark, sf_dir):
    listeners = table(spark, sf_dir, "lineitem").selectExpr("concat('h', l_suppkey) as host", "8000 + l_linenumber as port", "unix_seconds(cast(l_shipdate as timestamp)) as epoch_s")
    known = table(spark, sf_dir, "supplier").selectExpr("concat('h', s_suppkey) as host", "explode(array(8000, 8001, if(s_suppkey % 4 = 0, 8000, 8002), 8003)) as port")
    return an.exposure_drift(listeners, known)


@query("virtual_patch_coverage", """WITH x AS (SELECT DISTINCT s_suppkey AS asset_id, p_partkey AS advisory_id FROM supplier JOIN part ON s_nationkey = p_size),
 v AS (SELECT DISTINCT l_suppkey AS asset_id, l_partkey AS advisory_id FROM lineitem)
SELECT asset_id, advisory_id, CASE WHEN v.ok IS NULL THEN 'uncovered' WHEN x.ok IS NULL THEN 'orphaned' ELSE 'covered' END AS status FROM (SELECT *, true AS ok FROM x) x FULL JOIN (SELECT *, true AS ok FROM v) v USING (asset_id, advisory_id)""")
def virtual_patch_coverage(spark, sf_dir):
    assets = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as asset_id", "s_nationkey as product")
    advisories = table(spark, sf_dir, "part").selectExpr("p_partkey as advisory_id", "p_size as product")
    patches = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as asset_id", "l_partkey as advisory_id")
    return an.virtual_patch_coverage(assets, advisories, patches)


@query("source_health", f"""WITH g AS (SELECT 'src-' || l_suppkey AS source_id, CAST(floor(epoch(l_shipdate)) AS BIGINT) // 2592000 AS period, count(*) AS volume, count(*) FILTER (l_returnflag = 'R') AS failures, CAST(max(epoch(l_shipdate)) AS BIGINT) AS last_s FROM lineitem GROUP BY 1, 2),
 h AS (SELECT *, lag(volume) OVER (PARTITION BY source_id ORDER BY period) AS previous FROM g)
SELECT source_id, period, volume, failures, {_T0} - last_s AS age_s, previous, coalesce(volume >= previous * 3 OR volume * 3 <= previous, false) AS sudden FROM h""")
def source_health(spark, sf_dir):
    records = table(spark, sf_dir, "lineitem").selectExpr("concat('src-', l_suppkey) as source_id", "unix_seconds(cast(l_shipdate as timestamp)) as epoch_s", "l_returnflag = 'R' as failed")
    return an.source_health(records, _T0, 2_592_000)


@query("service_measures", f"""WITH {_ACTIONS}, m AS (SELECT count(*) AS actions, count(*) FILTER (state IN ('applied', 'verified', 'drifted')) AS live, count(*) FILTER (state IN ('applied', 'verified', 'drifted') AND verified_at IS NULL) AS unverified,
  count(*) FILTER (state IN ('applied', 'verified', 'drifted') AND expires_at < TIMESTAMP '2000-06-01') AS stale, CAST(sum(seq % 1000) AS BIGINT) AS latency_sum_s, max(seq % 1000) AS latency_max_s FROM act)
SELECT *, unverified * 1000000 // live AS unverified_micros, stale * 1000000 // live AS stale_micros FROM m""")
def service_measures(spark, sf_dir):
    acts = actions(spark, sf_dir).withColumn("decided_at", F.timestamp_seconds(F.unix_seconds("created_at") - F.col("seq") % 1000))
    return an.service_measures(acts, utc_literal(NOW))


@query("explain_block", f"""WITH {_ACTIONS}, rp AS (SELECT event_id AS report_id, 'rule-' || (user_id % 400) AS target, TIMESTAMP '2000-01-01' + to_days(CAST(event_id % 700 AS INT)) AS reported_at FROM events WHERE event_type = 'error')
SELECT report_id, rp.target, action_id, action_id || '-r' AS receipt_id FROM rp JOIN act ON act.rule_id = rp.target AND reported_at >= created_at AND (expires_at IS NULL OR reported_at < expires_at)""")
def explain_block(spark, sf_dir):
    reports = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "event_id as report_id", "concat('rule-', user_id % 400) as target", "timestamp'2000-01-01 00:00:00' + make_interval(0, 0, 0, cast(event_id % 700 as int)) as reported_at")
    acts = actions(spark, sf_dir).withColumn("target", F.col("rule_id"))
    decided = acts.selectExpr("decision_id", "'x' as disposition", "'L0' as rung", "array('r') as reason_codes").distinct()
    receipts = acts.selectExpr("action_id", "concat(action_id, '-r') as receipt_id")
    return ledger.explain_block(reports, acts, decided, receipts).select("report_id", "target", "action_id", "receipt_id")


_COMPROMISED = "src-2"


@query("source_compromise_impact", f"""WITH a AS (WITH {decided_sql()} SELECT * FROM decided), b AS (WITH {decided_sql().replace("s_suppkey % 17 <> 3 AS enabled", "s_suppkey % 17 <> 3 AND s_suppkey <> 2 AS enabled")} SELECT * FROM decided), {EVIDENCE_SQL},
t AS (SELECT DISTINCT indicator_id FROM evi WHERE source_id = 'src-2')
SELECT a.indicator_id, a.disposition AS old_disposition, b.disposition AS new_disposition, a.rung AS old_rung, b.rung AS new_rung FROM a JOIN b USING (indicator_id) JOIN t USING (indicator_id)""")
def source_compromise_impact(spark, sf_dir):
    indicators, evidence, sources = _inputs(spark, sf_dir)
    indicators, evidence = an.resting_on(indicators, evidence, _COMPROMISED)
    without = sources.withColumn("enabled", F.col("enabled") & (F.col("source_id") != _COMPROMISED))
    before = decide(indicators, evidence, sources, POLICY)
    resting = an.decisions_resting_on(before, evidence, _COMPROMISED)
    after = decide(indicators, evidence, without, POLICY)
    return budgets.replay_changes(resting, after.join(resting.select("indicator_id"), "indicator_id", "left_semi")) \
        .select("indicator_id", "old_disposition", "new_disposition", "old_rung", "new_rung")
