"""Evidence, scoring and decision queries over the shared tables, with SQL twins."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from threatloom.functions.instants import utc_literal
from threatloom.operators import evidence as ev
from threatloom.operators.targets import GovernedLists
from threatloom.plans import budgets
from threatloom.plans.decide import apply_ladder, decide, scored_indicators
from threatloom.plans.policy import AllowEntry, OVERLAY_SCHEMA, Policy, WEIGHTS, effective_policies
from threatloom.queries import frames as f
from threatloom.queries.frames import EVIDENCE_SQL, INDICATORS_SQL, SOURCES_SQL
from threatloom.queries.registry import Registry
from threatloom.session import cut_lineage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _address(k: int) -> str:
    return f"198.51.{96 + k % 32}.{(k // 32) % 256}"


FAMILIES_ON = ("beacon_periodicity", "dga_likelihood", "dns_tunneling", "volume_anomaly", "first_seen_novelty",
               "tls_metadata_mismatch", "sync_first_contact")
GOVERNED = tuple(sorted({_address(k) for k in range(800) if k % 8 in (3, 4)}))
ROLLBACK = tuple(sorted({_address(k) for k in range(400) if k % 8 in (3, 5)} | {f"p{k}.invalid" for k in range(400) if k % 8 == 1}))
ALLOWED = (AllowEntry("p1.invalid", "*"), AllowEntry("p2.invalid", "tables", "2001-01-01T00:00:00Z"),
           AllowEntry("p8.invalid", "tables", "whenever"), AllowEntry(_address(3), "elsewhere"), AllowEntry(_address(4), "tables", "2030-01-01T00:00:00Z"))
POLICY = Policy(
    version="tables-1", now="2001-06-01T00:00:00Z", mode="ENFORCE", scope="tables", observe_m=10,
    rung_floors={"L1": (15, 5), "L2": (30, 20), "L4": (40, 25), "L5": (20, 25)}, deny_families=1, authorized_prefixes=("198.51.96.0/20",),
    authorized_domains=("invalid",), allowlist=ALLOWED, enabled_families=FAMILIES_ON, max_evidence_per_indicator=12,
    recency_max_age_hours=24.0 * 700, governed_dedicated_use=GOVERNED, governed_verified_rollback=ROLLBACK, randomization=True,
    bounds_version="rv-1", rotation_interval_s=86_400, ttl_jitter=(0.8, 1.0), nominal_rate_ceiling=240, rate_ceiling_jitter=(0.5, 1.0),
    max_challenged_fraction=0.05, measured_transactions=1000)


def _inputs(spark, sf_dir):
    return f.indicators(spark, sf_dir), f.evidence(spark, sf_dir), f.sources(spark, sf_dir)


def decisions(spark, sf_dir, policy=POLICY):
    return decide(*_inputs(spark, sf_dir), policy)


# --- SQL twins --------------------------------------------------------------------

def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


_WEIGHTS_SQL = "wt(cls, kind, m, s_ctx, s_ip) AS (VALUES " + ", ".join(
    f"('{c}', '{k}', {m}, {a}, {b})" for (c, k), (m, a, b) in WEIGHTS.items()) + ")"
PROVENANCE_SQL = f"""{SOURCES_SQL}, {EVIDENCE_SQL},
pv AS (SELECT e.*, coalesce(s.source_class, 'unregistered') AS source_class,
    CASE WHEN s.source_class IS NOT NULL AND s.enabled THEN s.source_class ELSE 'unregistered' END AS eff,
    CASE WHEN s.source_class IS NULL THEN 'unregistered:' || e.source_id ELSE coalesce(s.upstream, e.source_id) END AS identity,
    coalesce(s.independent AND s.auto_enforcement_allowed, false) AS qualified
  FROM evi e LEFT JOIN src s USING (source_id))"""


def _fresh_sql(policy):
    return (f"epoch(TIMESTAMP '{policy.now[:10]} 00:00:00') - epoch(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ')) "
            f"BETWEEN -300 AND {int(policy.recency_max_age_hours * 3600)}")


def bounded_sql(policy=POLICY):
    families = _quoted("behavioral_" + x for x in policy.enabled_families)
    off = f"kind LIKE 'behavioral\\_%' ESCAPE '\\' AND kind NOT IN ({families})" if families else "false"
    return f"""{PROVENANCE_SQL},
be AS (SELECT *, {off} AS off FROM pv WHERE eff NOT IN ('annotation', 'attribution', 'unregistered')),
kept AS (SELECT *, row_number() OVER (PARTITION BY indicator_id, identity, kind, observed_at ORDER BY evidence_id) AS dn FROM be WHERE NOT off),
de AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY evidence_id) AS rn FROM kept WHERE dn = 1),
bo AS (SELECT *, {_fresh_sql(policy)} AS fresh FROM de WHERE rn <= {policy.max_evidence_per_indicator})"""


_SCOPE_SQL = """CASE WHEN itype IN ('ipv4', 'cidr') THEN CAST(split_part(value, '.', 3) AS INT) BETWEEN 96 AND 111
    ELSE value LIKE '%.invalid' END"""


@dataclasses.dataclass(frozen=True)
class ListsSql:
    """The conditions of a policy's lists where they are tables: indicators, further CTEs, and one condition a list."""

    indicators: str
    tables: str
    scope: str
    allow: str
    dedicated: str
    rollback: str


def scored_sql(policy=POLICY, lists: ListsSql | None = None):
    cap = policy.max_evidence_per_indicator
    dedicated = lists.dedicated if lists else f"value IN ({_quoted(policy.governed_dedicated_use) or "''"})"
    rollback = lists.rollback if lists else f"value IN ({_quoted(policy.governed_verified_rollback) or "''"})"
    return f"""{lists.indicators + ', ' + lists.tables if lists else INDICATORS_SQL}, {bounded_sql(policy)}, {_WEIGHTS_SQL},
sc AS (SELECT *, {lists.scope if lists else _SCOPE_SQL} AS in_scope FROM ind),
fa AS (SELECT b.*, sc.in_scope, sc.value, max(fresh) OVER w AS any_fresh,
    count(DISTINCT CASE WHEN eff IN ('curated', 'community') AND qualified AND kind IN ('curated_source', 'direct_local_detection') AND fresh THEN identity END) OVER w AS ups
  FROM bo b JOIN sc USING (indicator_id) WINDOW w AS (PARTITION BY indicator_id)),
st AS (SELECT fa.*, coalesce(x.m, a.m, 0) AS bm0, coalesce(x.s_ctx, a.s_ctx, 0) AS bc0, coalesce(x.s_ip, a.s_ip, 0) AS bi0,
    x.m IS NOT NULL OR a.m IS NOT NULL AS weighted, coalesce(pl.m, 0) AS plain,
    CASE WHEN fa.kind LIKE 'behavioral%' AND eff <> 'local' THEN 'v'
      WHEN (fa.kind = 'recent' AND NOT any_fresh) OR (fa.kind = 'bounded_scope' AND NOT in_scope) OR (fa.kind = 'exactness' AND value = '')
        OR (fa.kind IN ('dedicated_use', 'dedicated_use_provenance') AND NOT ({dedicated}))
        OR (fa.kind = 'verified_rollback' AND NOT ({rollback})) THEN 'u' ELSE 'c' END AS stand
  FROM fa LEFT JOIN wt x ON x.cls = eff AND x.kind = fa.kind LEFT JOIN wt a ON a.cls = 'any' AND a.kind = fa.kind AND eff IN ('curated', 'local')
  LEFT JOIN wt pl ON pl.cls = eff AND pl.kind = 'curated_source'),
un AS (SELECT *, stand = 'c' AND kind IN ('single_curated_source', 'two_curated_sources') AND bm0 > 0 AND fresh
    AND ups < CASE WHEN kind = 'two_curated_sources' THEN 2 ELSE 1 END AS unproven FROM st),
ct AS (SELECT *, CASE WHEN stand <> 'c' THEN 0 WHEN unproven THEN plain WHEN fresh THEN bm0 ELSE least(0, bm0) END AS cm,
    CASE WHEN stand = 'c' AND fresh AND kind NOT IN ('shared_cloud', 'shared_cdn', 'shared_hosting', 'anonymizer', 'fastflux_shared') THEN bc0 ELSE 0 END AS cc,
    CASE WHEN stand = 'c' AND fresh THEN bi0 ELSE 0 END AS ci FROM un),
rs AS (SELECT *, list_filter([CASE WHEN stand = 'v' THEN 'provenance_violation:' || kind END,
    CASE WHEN stand = 'u' THEN 'control_plane_claim_unverified:' || kind END,
    CASE WHEN stand = 'c' AND NOT weighted THEN 'unweighted:' || eff || ':' || kind END,
    CASE WHEN unproven THEN 'corroboration_claim_unverified:' || kind || ':distinct_upstreams=' || ups END,
    CASE WHEN cm <> 0 OR cc <> 0 OR ci <> 0 THEN kind END], lambda x: x IS NOT NULL) AS why FROM ct),
ag AS (SELECT indicator_id, sum(cm) AS m_total, sum(CASE WHEN eff = 'local' AND kind LIKE 'behavioral%' THEN cm ELSE 0 END) AS bm,
    greatest(0, least(100, sum(cc))) AS s_ctx, greatest(0, least(100, sum(ci))) AS s_ip,
    bool_or(stand = 'c' AND fresh AND kind IN ('dedicated_use', 'dedicated_use_provenance')) AS ded, bool_or(stand <> 'c' OR NOT weighted) AS unq,
    bool_or(kind IN ('shared_cloud', 'shared_cdn', 'shared_hosting', 'anonymizer', 'fastflux_shared')) AS shared, max(ups) AS ups,
    count(DISTINCT CASE WHEN eff = 'local' AND kind LIKE 'behavioral%' THEN kind END) AS fams, flatten(list(why)) AS why
  FROM rs GROUP BY 1),
dc AS (SELECT indicator_id, count(*) FILTER (dn > 1) AS dup FROM kept GROUP BY 1),
tr AS (SELECT indicator_id, greatest(max(rn) - {cap}, 0) AS trunc FROM de GROUP BY 1),
fo AS (SELECT indicator_id, list(DISTINCT 'behavioral_family_disabled_by_policy:' || kind) AS why FROM be WHERE off GROUP BY 1),
s0 AS (SELECT sc.*, coalesce(m_total, 0) AS m_total, coalesce(bm, 0) AS bm, coalesce(s_ctx, 0) AS s_ctx, coalesce(s_ip, 0) AS s_ip,
    coalesce(ded, false) AS ded, coalesce(unq, false) AS unq, coalesce(shared, false) AS shared, coalesce(ups, 0) AS ups, coalesce(fams, 0) AS fams,
    coalesce(dup, 0) AS dup, coalesce(trunc, 0) AS trunc, coalesce(ag.why, []) AS w1, coalesce(fo.why, []) AS w2,
    CASE WHEN coalesce(fams, 0) = 0 THEN 100 WHEN fams >= greatest(1, {policy.rate_limit_families}) THEN {policy.corroborated_max_behavioral_m} ELSE {policy.max_behavioral_m} END AS cap_m
  FROM sc LEFT JOIN ag USING (indicator_id) LEFT JOIN dc USING (indicator_id) LEFT JOIN tr USING (indicator_id) LEFT JOIN fo USING (indicator_id)),
scored AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN bm > cap_m THEN m_total - bm + cap_m ELSE m_total END)) AS BIGINT) AS m,
    CASE WHEN shared THEN 'shared' WHEN ded THEN 'dedicated' ELSE 'unknown' END AS infra,
    list_concat(list_concat(w1, w2), list_filter([CASE WHEN dup > 0 THEN 'evidence_deduplicated:' || dup END,
      CASE WHEN trunc > 0 THEN 'evidence_envelope_truncated:' || trunc END, CASE WHEN bm > cap_m THEN 'behavioral_m_capped' END,
      CASE WHEN unq THEN 'unqualified_evidence_present' END], lambda x: x IS NOT NULL)) AS why FROM s0)"""


CONTEXT_SQL = """cv AS (SELECT indicator_id, client, count(*) AS n FROM evi GROUP BY 1, 2),
cb AS (SELECT indicator_id, (min(struct_pack(n := -n, v := client))).v AS client FROM cv GROUP BY 1),
qv AS (SELECT indicator_id, protocol_class, count(*) AS n FROM evi WHERE protocol_class IN ('interactive_http', 'dns') GROUP BY 1, 2),
qb AS (SELECT indicator_id, (min(struct_pack(n := -n, v := protocol_class))).v AS protocol FROM qv GROUP BY 1),
ctx AS (SELECT indicator_id, client, CASE WHEN protocol <> 'dns' THEN protocol END AS protocol FROM cb FULL JOIN qb USING (indicator_id))"""


def _draw_sql(seed, nominal, lo, hi, domain="drbg-v1"):
    word = f"('0x' || substr(sha256(unhex(sha256('{domain}|' || {seed})) || unhex('0000000000000000')), 1, 16))::UBIGINT"
    return f"({lo} + CAST({word} % {hi - lo + 1} AS BIGINT))"


def decided_sql(policy=POLICY, out="decided", lists: ListsSql | None = None):
    fl = policy.rung_floors
    allow = " WHEN ".join(
        f"value = '{e.canonical}' THEN {'true' if e.expires_at is None or e.expires_at > policy.now and e.expires_at[:1].isdigit() else 'false'}"
        for e in policy.allowlist if e.scope in ("*", policy.scope)) or "false THEN false"
    epoch = f"CAST(epoch(TIMESTAMP '{policy.now[:10]} 00:00:00') AS BIGINT) // {policy.rotation_interval_s}"
    floor_case = lambda r, s: f"(m >= {fl[r][0]} AND {s} >= {fl[r][1]})" if r in fl else "false"
    mode = policy.mode
    acting = {"ENFORCE": "AUTO_ENFORCE", "SHADOW": "SHADOW_ACTION", "EMERGENCY": "PROPOSE_OPERATOR_APPROVAL"}.get(mode, "SHADOW_ACTION")
    held = "PROPOSE_OPERATOR_APPROVAL" if mode in ("ENFORCE", "EMERGENCY") else "SHADOW_ACTION"
    def reason(cond, text):
        # A rung without a floor is skipped before any of its gates speak.
        rung = next((r for r in ("L1", "L2", "L4", "L5") if r in text or r.lower() + "_requires" in text), None)
        return "NULL" if rung and rung not in fl else f"CASE WHEN {cond} THEN '{text}' END"

    return f"""{scored_sql(policy, lists)}, {CONTEXT_SQL},
l0 AS (SELECT s.*, CASE WHEN regexp_full_match(c.client, '[A-Za-z0-9_.:-]{{1,128}}') THEN c.client END AS client,
    c.client IS NOT NULL AND NOT regexp_full_match(c.client, '[A-Za-z0-9_.:-]{{1,128}}') AS unsafe, c.protocol, itype IN ('ipv4', 'ipv6') AS ip, itype = 'fqdn' AS fqdn, fams > 0 AND fams < {policy.deny_families} AS thin,
    fams > 0 AND {str(policy.deny_requires_external).lower()} AND ups = 0 AS alone, infra <> 'dedicated' OR NOT ded AS noded,
    coalesce(regexp_full_match(c.client, '[A-Za-z0-9_.:-]{{1,128}}'), false) AS hasc, c.protocol IS NOT NULL AS inter,
    {lists.allow if lists else f'CASE WHEN {allow} ELSE false END'} AS allow FROM scored s LEFT JOIN ctx c USING (indicator_id)),
l1 AS (SELECT *, CASE WHEN ip AND NOT thin AND NOT alone AND NOT noded AND {floor_case('L5', 's_ip')} THEN 'L5'
    WHEN fqdn AND NOT thin AND NOT alone AND {floor_case('L4', 's_ctx')} THEN 'L4' WHEN (ip OR fqdn) AND hasc AND {floor_case('L2', 's_ctx')} THEN 'L2'
    WHEN itype <> 'cidr' AND hasc AND inter AND {floor_case('L1', 's_ctx')} THEN 'L1' ELSE 'L0' END AS lr,
    CASE WHEN NOT in_scope THEN 'out' WHEN allow THEN 'allow' WHEN {str(mode == 'OFF').lower()} OR m < {policy.observe_m} THEN 'quiet'
      WHEN {str(mode == 'OBSERVE').lower()} THEN 'observe' WHEN fqdn AND contains(value, '*') THEN 'wild'
      WHEN itype = 'cidr' AND {str(mode != 'EMERGENCY').lower()} THEN 'cidr' ELSE 'ladder' END AS path FROM l0),
l2 AS (SELECT *, CASE path WHEN 'observe' THEN 'L0' WHEN 'wild' THEN 'L4' WHEN 'ladder' THEN lr ELSE 'NONE' END AS rung,
    CASE WHEN path IN ('observe', 'cidr') THEN 'OBSERVE' WHEN path = 'wild' THEN '{held}' WHEN path = 'ladder' AND lr <> 'L0' THEN '{acting}'
      WHEN path = 'ladder' THEN 'OBSERVE' ELSE 'NO_ACTION' END AS disposition,
    CASE WHEN path = 'observe' THEN 'observe' WHEN path = 'wild' THEN 'dns_nxdomain' WHEN path = 'cidr' THEN 'firewall_deny'
      WHEN path = 'ladder' THEN CASE lr WHEN 'L1' THEN 'proxy_challenge' WHEN 'L2' THEN 'rate_limit' WHEN 'L4' THEN 'dns_nxdomain' WHEN 'L5' THEN 'firewall_deny' ELSE 'observe' END
      ELSE 'none' END AS action,
    list_filter([{reason("path = 'out'", 'out_of_authorized_scope')}, CASE WHEN path = 'allow' THEN 'allowlist_hit:' || value END,
      {reason("path = 'allow'", 'allowlist_precedence')}, {reason("path = 'wild'", 'wildcard_requires_approval')}, {reason("path = 'cidr'", 'prefix_requires_approval')},
      {reason("path = 'cidr'", 'materialization_unavailable:no_supported_adapter')},
      {reason("path = 'ladder' AND unsafe", 'client_selector_unsafe_for_artifacts')}, {reason("path = 'ladder' AND thin", 'behavioral_corroboration_insufficient')}, {reason("path = 'ladder' AND alone", 'behavioral_deny_needs_external_corroboration')},
      {reason("path = 'ladder' AND ip AND noded AND infra = 'shared'", 'demoted_shared_infra')}, {reason("path = 'ladder' AND ip AND noded AND infra <> 'shared'", 'demoted_unknown_infra')},
      {reason("path = 'ladder' AND itype <> 'cidr' AND NOT inter", 'l1_requires_interactive_protocol')},
      {reason("path = 'ladder' AND itype <> 'cidr' AND NOT hasc", 'l1_requires_client_selector')}, {reason("path = 'ladder' AND (ip OR fqdn) AND NOT hasc", 'l2_requires_pair_selector')},
      {reason("path = 'ladder' AND ip AND NOT thin AND NOT alone AND NOT noded AND NOT " + floor_case('L5', 's_ip'), 'below_L5_floor')},
      {reason("path = 'ladder' AND fqdn AND NOT thin AND NOT alone AND NOT " + floor_case('L4', 's_ctx'), 'below_L4_floor')},
      {reason("path = 'ladder' AND (ip OR fqdn) AND hasc AND NOT " + floor_case('L2', 's_ctx'), 'below_L2_floor')},
      {reason("path = 'ladder' AND itype <> 'cidr' AND hasc AND inter AND NOT " + floor_case('L1', 's_ctx'), 'below_L1_floor')}], lambda x: x IS NOT NULL) AS lwhy FROM l1),
l3 AS (SELECT *, array_to_string(list_sort(list_distinct(list_concat(why, lwhy))), ';') AS reason_codes,
    'decision--' || substr(sha256(concat_ws('|', indicator_id, itype, value, '{policy.version}', m, CAST(s_ctx AS BIGINT), CAST(s_ip AS BIGINT), action, disposition, rung, '{policy.scope}')), 1, 24) AS decision_id,
    CASE WHEN path = 'ladder' AND lr <> 'L0' AND {str(mode != 'EMERGENCY').lower()} THEN {min(3600, policy.max_auto_ttl_seconds)} ELSE 0 END AS nominal_ttl,
    concat_ws('|', indicator_id, itype, value, '{policy.version}', m, CAST(s_ctx AS BIGINT), '{policy.scope}', '{policy.bounds_version}', {epoch}) AS rbody FROM l2),
l4 AS (SELECT *, {_draw_sql("'rate-ceiling|' || rbody", 240, 500000, 1000000)} AS rfrac,
    {_draw_sql(f"concat_ws('|', 'ttl-jitter', decision_id, '{policy.bounds_version}', {epoch})", 3600, 800000, 1000000)} AS tfrac FROM l3),
{out} AS (SELECT decision_id, indicator_id, itype, value, tenant_id, batch_id, pos, m AS maliciousness, CAST(s_ctx AS BIGINT) AS s_ctx, CAST(s_ip AS BIGINT) AS s_ip,
    CAST(CASE WHEN rung = 'L5' THEN s_ip ELSE s_ctx END AS BIGINT) AS action_safety, disposition, action, rung, reason_codes,
    CAST(nominal_ttl AS BIGINT) AS nominal_ttl_seconds, CAST(CASE WHEN nominal_ttl > 0 THEN greatest(1, least(nominal_ttl, nominal_ttl * tfrac // 1000000)) ELSE 0 END AS BIGINT) AS ttl_seconds,
    CASE WHEN rung = 'L2' THEN 'client_destination_pair' WHEN rung = 'L1' THEN 'client_session' END AS scope_type,
    CASE WHEN rung IN ('L1', 'L2') THEN client END AS client, CASE WHEN rung IN ('L1', 'L2') THEN protocol END AS protocol_class,
    CAST(CASE WHEN rung = 'L2' THEN greatest(1, least(240, 240 * rfrac // 1000000)) END AS BIGINT) AS rate_ceiling,
    CASE WHEN path = 'out' THEN 'Target outside authorized scope; no action possible. M=' || m || ', S_ctx=' || CAST(s_ctx AS BIGINT) || '.'
      WHEN path = 'allow' THEN 'Allowlisted target; enforcement suppressed. M=' || m || ', S_ctx=' || CAST(s_ctx AS BIGINT) || '.'
      ELSE 'M=' || m || ', S_ctx=' || CAST(s_ctx AS BIGINT) || ', S_ip=' || CAST(s_ip AS BIGINT) || ', type=' || itype || ', infra=' || infra || ', families=' || fams
        || ', external_qualified=' || CASE WHEN ups > 0 THEN 'True' ELSE 'False' END || ', mode={mode}, rung=' || rung || ', disposition=' || disposition || ', action=' || action
        || CASE WHEN rung = 'L2' THEN ', rate_ceiling_per_min=' || greatest(1, least(240, 240 * rfrac // 1000000)) ELSE '' END || '.'
        || CASE WHEN nominal_ttl > 0 THEN ' ttl_jitter=' || printf('%.3f', tfrac / 1000000.0) || '.' ELSE '' END END AS explanation
  FROM l4)"""


FLAT = ("decision_id", "indicator_id", "maliciousness", "s_ctx", "s_ip", "action_safety", "disposition", "action", "rung",
        "nominal_ttl_seconds", "ttl_seconds")


def flat(df, *more):
    """Decision columns in the form both engines can compare."""
    return df.select(*FLAT, *more, F.array_join("reason_codes", ";").alias("reason_codes"), F.col("selector.scope_type").alias("scope_type"),
                     F.col("selector.client").alias("client"), F.col("selector.protocol_class").alias("protocol_class"),
                     F.col("selector.rate_ceiling_per_min").alias("rate_ceiling"), "explanation")


FLAT_SQL = ", ".join((*FLAT, "reason_codes", "scope_type", "client", "protocol_class", "rate_ceiling", "explanation"))


# --- evidence queries ---------------------------------------------------------------

@query("evidence_provenance", f"WITH {PROVENANCE_SQL} SELECT evidence_id, indicator_id, source_id, source_class, eff AS effective_class, identity, qualified AS qualified_source FROM pv")
def evidence_provenance(spark, sf_dir):
    return ev.with_provenance(f.evidence(spark, sf_dir), f.sources(spark, sf_dir)) \
        .select("evidence_id", "indicator_id", "source_id", "source_class", "effective_class", "identity", "qualified_source")


def _bearing(spark, sf_dir, policy=POLICY):
    proven = ev.with_provenance(f.evidence(spark, sf_dir), f.sources(spark, sf_dir))
    return ev.decision_bearing(proven, F.array(*[F.lit(x) for x in policy.enabled_families]))


@query("evidence_family_gate", f"WITH {bounded_sql()} SELECT indicator_id, array_to_string(list_sort(list(DISTINCT kind)), ';') AS disabled_kinds FROM be WHERE off GROUP BY 1")
def evidence_family_gate(spark, sf_dir):
    return ev.disabled_kinds(_bearing(spark, sf_dir)).select("indicator_id", F.array_join("disabled_kinds", ";").alias("disabled_kinds"))


@query("evidence_dedup", f"WITH {bounded_sql()}, n AS (SELECT indicator_id, identity, kind, observed_at, count(*) AS copies FROM kept GROUP BY ALL) "
       "SELECT indicator_id, identity, kind, observed_at, evidence_id, source_id, copies FROM kept JOIN n USING (indicator_id, identity, kind, observed_at) WHERE dn = 1")
def evidence_dedup(spark, sf_dir):
    return ev.dedup_evidence(_bearing(spark, sf_dir).where("not off")).select("indicator_id", "identity", "kind", "observed_at", "evidence_id", "source_id", "copies")


@query("evidence_envelope", f"WITH {bounded_sql()} SELECT indicator_id, evidence_id, kind FROM bo")
def evidence_envelope(spark, sf_dir):
    return ev.envelope(ev.dedup_evidence(_bearing(spark, sf_dir).where("not off")), POLICY.max_evidence_per_indicator).select("indicator_id", "evidence_id", "kind")


@query("corroboration_tier", f"WITH {PROVENANCE_SQL}, d AS (SELECT indicator_id, count(DISTINCT CASE WHEN source_class IN ('curated', 'community') AND qualified "
       f"AND kind IN ('curated_source', 'direct_local_detection') AND {_fresh_sql(POLICY)} THEN identity END) AS distinct_upstreams FROM pv GROUP BY 1) "
       "SELECT *, CASE WHEN distinct_upstreams >= 2 THEN 1 ELSE 0 END AS tier FROM d")
def corroboration_tier(spark, sf_dir):
    return ev.corroboration(ev.with_provenance(f.evidence(spark, sf_dir), f.sources(spark, sf_dir)), utc_literal(POLICY.now), POLICY.recency_max_age_hours)


@query("registry_independent_sources", f"WITH {SOURCES_SQL} SELECT count(DISTINCT CASE WHEN independent AND source_class <> 'annotation' THEN coalesce(upstream, source_id) END) AS independent_sources FROM src")
def registry_independent_sources(spark, sf_dir):
    return ev.independent_sources(f.sources(spark, sf_dir))


@query("observation_context", f"WITH {EVIDENCE_SQL}, {CONTEXT_SQL} SELECT indicator_id, client, protocol AS protocol_class FROM ctx")
def observation_context(spark, sf_dir):
    return ev.observation_context(f.evidence(spark, sf_dir))


@query("unambiguous_subject", f"WITH {EVIDENCE_SQL} SELECT indicator_id, CASE WHEN count(DISTINCT client) = 1 THEN min(client) END AS subject "
       "FROM evi WHERE kind IN ('behavioral_beacon_periodicity', 'behavioral_first_seen_novelty') GROUP BY 1")
def unambiguous_subject(spark, sf_dir):
    return ev.unambiguous_subject(f.evidence(spark, sf_dir))


# --- scoring and decisions -----------------------------------------------------------

@query("score_indicators", f"WITH {scored_sql()} SELECT indicator_id, m, CAST(s_ctx AS BIGINT) AS s_ctx, CAST(s_ip AS BIGINT) AS s_ip, CAST(bm AS BIGINT) AS bm, fams AS families, "
       "ups AS external_upstreams, ded AS has_dedicated, infra AS infra_state, array_to_string(list_sort(list_distinct(why)), ';') AS reasons FROM scored")
def score_indicators(spark, sf_dir):
    return scored_indicators(*_inputs(spark, sf_dir), POLICY).select(
        "indicator_id", "m", "s_ctx", "s_ip", "bm", "families", "external_upstreams", "has_dedicated", "infra_state",
        F.array_join(F.array_sort(F.array_distinct("score_reasons")), ";").alias("reasons"))


@query("decide_indicators", f"WITH {decided_sql()} SELECT {FLAT_SQL} FROM decided")
def decide_indicators(spark, sf_dir):
    return flat(decisions(spark, sf_dir))


SHADOW = dataclasses.replace(POLICY, mode="SHADOW", version="tables-2", rung_floors={"L2": (50, 30), "L4": (70, 40)}, observe_m=20)


@query("decide_indicators_shadow", f"WITH {decided_sql(SHADOW)} SELECT {FLAT_SQL} FROM decided")
def decide_indicators_shadow(spark, sf_dir):
    return flat(decisions(spark, sf_dir, SHADOW))


_DEMOTE = {"decision_id": "decision_id || '{suffix}'", "disposition": "'OBSERVE'", "action": "'observe'", "rung": "'L0'", "ttl_seconds": "0",
           "reason_codes": "array_to_string(list_sort(list_distinct(list_concat(string_split(reason_codes, ';'), {reasons}))), ';')"}


def _demoted_sql(over, suffix, reasons, source):
    cols = ["indicator_id", *_DEMOTE]
    picks = ", ".join(f"CASE WHEN {over} THEN {_DEMOTE[c].format(suffix=suffix, reasons=reasons)} ELSE {c} END AS {c}" if c in _DEMOTE else c for c in cols)
    return f"SELECT {picks} FROM {source}"


def _short(df):
    return df.select("indicator_id", "decision_id", "disposition", "action", "rung", "ttl_seconds", F.array_join("reason_codes", ";").alias("reason_codes"))


@query("action_budget", f"WITH {decided_sql()}, b AS (SELECT *, disposition IN ('AUTO_ENFORCE', 'SHADOW_ACTION') AS act, "
       "sum(CASE WHEN disposition IN ('AUTO_ENFORCE', 'SHADOW_ACTION') THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY pos) AS n FROM decided) "
       + _demoted_sql("act AND n > 20", "-demoted", "['blast_radius_budget_exceeded']", "b"))
def action_budget(spark, sf_dir):
    # Decisions are read twice (cutoffs and rows): materialise them once.
    return _short(budgets.apply_action_budget(cut_lineage(decisions(spark, sf_dir)), 20))


@query("client_impact_budget", f"WITH {decided_sql()}, b AS (SELECT *, action = 'proxy_challenge' AS ch, row_number() OVER (PARTITION BY action = 'proxy_challenge' ORDER BY decision_id) AS n FROM decided) "
       + _demoted_sql("ch AND n > 50", "-challenge-budget-reverted", "['client_impact_budget_exceeded', 'challenge_auto_reverted_to_L0']", "b"))
def client_impact_budget(spark, sf_dir):
    return _short(budgets.apply_client_impact_budget(cut_lineage(decisions(spark, sf_dir)), POLICY))


_REPLAY_SQL = f"""WITH a AS (WITH {decided_sql()} SELECT * FROM decided), b AS (WITH {decided_sql(SHADOW)} SELECT * FROM decided),
x AS (SELECT a.indicator_id, a.tenant_id, a.disposition AS old_disposition, b.disposition AS new_disposition, a.rung AS old_rung, b.rung AS new_rung,
   a.action IN ('dns_nxdomain', 'firewall_deny', 'rate_limit', 'proxy_challenge') AND a.disposition NOT IN ('OBSERVE', 'NO_ACTION') AS ob,
   b.action IN ('dns_nxdomain', 'firewall_deny', 'rate_limit', 'proxy_challenge') AND b.disposition NOT IN ('OBSERVE', 'NO_ACTION') AS nb
  FROM a JOIN b USING (indicator_id)),
y AS (SELECT indicator_id, tenant_id, old_disposition, new_disposition, old_rung, new_rung, CASE WHEN nb AND NOT ob THEN 'newly_blocked' WHEN ob AND NOT nb THEN 'block_removed'
   WHEN old_disposition = new_disposition AND old_rung = new_rung THEN 'unchanged' ELSE 'changed' END AS change_kind FROM x)"""


@query("policy_replay_diff", f"{_REPLAY_SQL} SELECT * FROM y")
def policy_replay_diff(spark, sf_dir):
    return budgets.replay_changes(decisions(spark, sf_dir), decisions(spark, sf_dir, SHADOW))


@query("policy_replay_summary", f"{_REPLAY_SQL} SELECT change_kind, count(*) AS indicators, count(DISTINCT tenant_id) AS tenants FROM y GROUP BY 1")
def policy_replay_summary(spark, sf_dir):
    return budgets.replay_summary(policy_replay_diff(spark, sf_dir))


def overlays(spark, sf_dir):
    """One overlay per nation: raised observe threshold, lowered TTL, narrowed domains."""
    return f.table(spark, sf_dir, "nation").selectExpr(
        "concat('t', n_nationkey) as tenant_id", "case n_nationkey % 4 when 1 then 'OBSERVE' when 2 then 'EMERGENCY' when 3 then 'SHADOW' end as mode",
        "cast(30 + n_nationkey * 5 as int) as observe_m", "cast(600 * (n_nationkey % 9) + 60 as int) as max_auto_ttl_seconds",
        "case when n_nationkey % 2 = 0 then array('corp.invalid', 'other.example') end as authorized_domains",
        "cast(n_nationkey * 4 + 50 as int) as L4_m")


@query("tenant_effective_policies", """SELECT 't' || n_nationkey AS tenant_id, CASE n_nationkey % 4 WHEN 1 THEN 'OBSERVE' WHEN 3 THEN 'SHADOW' ELSE 'ENFORCE' END AS mode,
  greatest(10, 30 + n_nationkey * 5) AS observe_m, least(3600, 600 * (n_nationkey % 9) + 60) AS max_auto_ttl_seconds,
  CASE WHEN n_nationkey % 2 = 0 THEN 'corp.invalid' ELSE 'invalid' END AS authorized_domains, greatest(40, n_nationkey * 4 + 50) AS l4_floor_m FROM nation""")
def tenant_effective_policies(spark, sf_dir):
    given = overlays(spark, sf_dir)
    absent = [c.strip().split(" ", 1) for c in _split_schema(OVERLAY_SCHEMA)]
    full = given.select(*[F.col(n) if n in given.columns else F.lit(None).cast(t).alias(n) for n, t in absent])
    return effective_policies(POLICY, full).select(
        "tenant_id", "_policy.mode", "_policy.observe_m", "_policy.max_auto_ttl_seconds",
        F.array_join("_policy.authorized_domains", ";").alias("authorized_domains"), F.col("_policy.L4_m").alias("l4_floor_m"))


def _split_schema(schema):
    depth, part = 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            yield part
            part = ""
        else:
            part += ch


@query("ladder_context_free", f"WITH {scored_sql()} SELECT indicator_id, CASE WHEN NOT in_scope THEN 'NONE' WHEN m < 10 THEN 'NONE' ELSE 'L0' END AS rung FROM scored")
def ladder_context_free(spark, sf_dir):
    """Observe mode: only the gates and the observe threshold decide."""
    observe = dataclasses.replace(POLICY, mode="OBSERVE", allowlist=())
    scored = scored_indicators(*_inputs(spark, sf_dir), POLICY)
    scored = scored.withColumns({"client": F.lit(None).cast("string"), "protocol_class": F.lit(None).cast("string")})
    return apply_ladder(scored, observe).select("indicator_id", "rung")


# --- lists as tables, both address families, tenant scopes --------------------------

_ITEM6 = "CASE WHEN p_partkey % 8 < 3 THEN 'fqdn' WHEN p_partkey % 8 < 6 THEN 'ipv4' WHEN p_partkey % 16 = 6 THEN 'cidr' WHEN p_partkey % 16 = 14 THEN 'cidr' WHEN p_partkey % 16 = 7 THEN 'ipv6' ELSE 'url' END"
_VALUE6 = """CASE WHEN p_partkey % 8 < 3 THEN concat('h', p_partkey, '.s', p_partkey % 300, '.example') WHEN p_partkey % 8 < 6 THEN concat('198.51.', p_partkey % 200, '.', {third})
      WHEN p_partkey % 16 = 6 THEN concat('198.51.', p_partkey % 200, '.0/24') WHEN p_partkey % 16 = 14 THEN concat('2001:db8:', {group}, '::/48')
      WHEN p_partkey % 16 = 7 THEN concat('2001:db8:', {group}, '::', {host}) ELSE concat('https://u', p_partkey, '.example') END"""


def _value6(spark: bool) -> str:
    number = lambda n: f"lower(hex({n}))" if spark else f"lower(printf('%x', {n}))"
    return _VALUE6.format(third="(p_partkey div 32) % 256" if spark else "(p_partkey // 32) % 256", group=number("p_partkey % 500 + 16"), host=number("p_partkey + 1"))


def indicators6(spark, sf_dir):
    return f.table(spark, sf_dir, "part").selectExpr(
        "concat('indicator--', p_partkey) as indicator_id", f"{_ITEM6} as itype", f"{_value6(True)} as value",
        "concat('t', p_partkey % 4) as tenant_id", "concat('b', p_partkey div 500) as batch_id", "p_partkey as pos")


LISTS_POLICY = dataclasses.replace(POLICY, authorized_prefixes=(), authorized_domains=(), allowlist=(), governed_dedicated_use=(), governed_verified_rollback=())


def governed_lists(spark, sf_dir):
    """Scope, allowlist and governed lists with an entry an order or more. Tenant t1 narrows its names, t2 its prefixes; t3 asks for what is not there."""
    orders = f.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = f.table(spark, sf_dir, "customer", "c_custkey")
    domains = orders.selectExpr("'*' as owner", "concat('S', o_orderkey % 5000 * 2, '.example.') as domain") \
        .unionByName(customers.selectExpr("case when c_custkey % 2 = 0 then 't1' else 't3' end as owner", "case when c_custkey % 2 = 0 then concat('h', c_custkey * 3, '.s', c_custkey * 3 % 300, '.example') else concat('x', c_custkey, '.elsewhere') end as domain"))
    prefixes = orders.selectExpr("'*' as owner", "concat('198.51.', o_orderkey % 100, '.0/24') as prefix") \
        .unionByName(orders.selectExpr("'*' as owner", "concat('2001:DB8:', hex(o_orderkey % 300 + 16), '::/48') as prefix")) \
        .unionByName(customers.selectExpr("case when c_custkey % 2 = 0 then 't2' else 't3' end as owner", "case when c_custkey % 2 = 0 then concat('198.51.', c_custkey % 50, '.128/25') else concat('203.0.113.', c_custkey % 256, '/32') end as prefix"))
    allowlist = orders.selectExpr(
        "o_orderkey as pos", "case o_orderkey % 3 when 0 then concat('2001:db8:', hex(o_custkey % 500 + 16), ':0:0::', hex(o_custkey + 1)) when 1 then concat('H', o_custkey, '.s', o_custkey % 300, '.example') else concat('198.51.', o_custkey % 200, '.', (o_custkey div 32) % 256) end as canonical",
        "case o_orderkey % 5 when 0 then 'other' when 1 then '*' else 'tables' end as scope", "case o_orderkey % 4 when 0 then '2001-01-01T00:00:00Z' when 1 then 'someday' when 2 then '2030-01-01T00:00:00Z' end as expires_at")
    items = indicators6(spark, sf_dir)
    return GovernedLists(domains, prefixes, allowlist, items.where("pos % 3 = 0").select("value"), items.where("pos % 5 < 2").select("value"))


_LISTS_SQL = ListsSql(
    indicators=f"ind AS (SELECT 'indicator--' || p_partkey AS indicator_id, {_ITEM6} AS itype, {_value6(False)} AS value, 't' || (p_partkey % 4) AS tenant_id, 'b' || (p_partkey // 500) AS batch_id, p_partkey AS pos FROM part)",
    tables="""gd AS (SELECT DISTINCT 's' || (o_orderkey % 5000 * 2) || '.example' AS d FROM orders), g4 AS (SELECT DISTINCT o_orderkey % 100 AS n FROM orders),
 g6 AS (SELECT DISTINCT printf('%x', o_orderkey % 300 + 16) AS n FROM orders),
 od AS (SELECT DISTINCT 'h' || (c_custkey * 3) || '.s' || (c_custkey * 3 % 300) || '.example' AS d FROM customer WHERE c_custkey % 2 = 0 AND 's' || (c_custkey * 3 % 300) || '.example' IN (SELECT d FROM gd)),
 o4 AS (SELECT DISTINCT c_custkey % 50 AS n FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 50 IN (SELECT n FROM g4)),
 al AS (SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN '2001:db8:' || printf('%x', o_custkey % 500 + 16) || '::' || printf('%x', o_custkey + 1) WHEN 1 THEN 'h' || o_custkey || '.s' || (o_custkey % 300) || '.example' ELSE '198.51.' || (o_custkey % 200) || '.' || ((o_custkey // 32) % 256) END AS k,
   o_orderkey % 4 AS e FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0),
 ah AS (SELECT k, arg_min(e, pos) AS e FROM al GROUP BY 1)""",
    scope="""CASE WHEN itype IN ('ipv4', 'cidr', 'ipv6') AND contains(value, ':') THEN (tenant_id <> 't2' OR NOT EXISTS (SELECT 1 FROM o4)) AND split_part(split_part(value, '::', 1), ':', 3) IN (SELECT n FROM g6)
    WHEN itype IN ('ipv4', 'cidr') AND tenant_id = 't2' AND EXISTS (SELECT 1 FROM o4) THEN itype = 'ipv4' AND TRY_CAST(split_part(value, '.', 3) AS INT) IN (SELECT n FROM o4) AND TRY_CAST(split_part(value, '.', 4) AS INT) >= 128
    WHEN itype IN ('ipv4', 'cidr') THEN TRY_CAST(split_part(value, '.', 3) AS INT) IN (SELECT n FROM g4)
    WHEN itype = 'url' THEN false
    WHEN tenant_id = 't1' AND EXISTS (SELECT 1 FROM od) THEN value IN (SELECT d FROM od)
    ELSE split_part(value, '.', 2) || '.example' IN (SELECT d FROM gd) END""",
    allow="value IN (SELECT k FROM ah WHERE e <> 1)", dedicated="value IN (SELECT value FROM ind WHERE pos % 3 = 0)", rollback="value IN (SELECT value FROM ind WHERE pos % 5 < 2)")


@query("decide_governed_lists", f"WITH {decided_sql(LISTS_POLICY, lists=_LISTS_SQL)} SELECT {FLAT_SQL}, itype, value FROM decided")
def decide_governed_lists(spark, sf_dir):
    decided = decide(indicators6(spark, sf_dir), f.evidence(spark, sf_dir), f.sources(spark, sf_dir), LISTS_POLICY, lists=governed_lists(spark, sf_dir))
    return flat(decided, "itype", "value")
