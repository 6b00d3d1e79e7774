"""Golden decisions for six indicators under a pinned clock, and decision properties."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from threatloom.plans.budgets import apply_action_budget, apply_client_impact_budget, replay_changes, stale_authorizations
from threatloom.plans.decide import decide
from threatloom.plans.policy import AllowEntry, OVERLAY_SCHEMA, Policy, effective_policies

NOW = "2026-09-01T20:00:00Z"
POLICY = Policy(
    version="2026-09-01.2", now=NOW, authorized_prefixes=("198.51.100.0/24", "203.0.113.0/24"), authorized_domains=("invalid",),
    governed_dedicated_use=("198.51.100.44",), governed_verified_rollback=("198.51.100.44", "c2-demo.invalid", "c2-on-cdn-demo.invalid"),
    enabled_families=("beacon_periodicity", "dga_likelihood", "dns_tunneling", "fastflux", "volume_anomaly", "first_seen_novelty",
                      "tls_metadata_mismatch"),
    randomization=True, bounds_version="rv-2026-09-01.1", ttl_jitter=(0.8, 1.0), nominal_rate_ceiling=240, rate_ceiling_jitter=(0.5, 1.0),
    max_actions_per_batch=100, max_challenged_fraction=0.05, measured_transactions=1000)

INDICATORS = [
    ("demo-domain", "fqdn", "c2-demo.invalid"), ("demo-ip-shared", "ipv4", "203.0.113.66"), ("demo-ip-dedicated", "ipv4", "198.51.100.44"),
    ("demo-dga-fresh", "fqdn", "x7fjq2m9zk4p8w.invalid"), ("demo-shared-c2", "fqdn", "c2-on-cdn-demo.invalid"),
    ("demo-poisoned", "fqdn", "score-injection-attempt.invalid"),
]
EVIDENCE = {
    "demo-domain": [("curated_source", "curated-a", "19:00"), ("curated_source", "curated-b", "19:05"),
                    ("direct_local_detection", "local-sensor", "19:50"), ("exact_fqdn", "local-sensor", "19:50"),
                    ("recent", "local-sensor", "20:00"), ("bounded_scope", "local-sensor", "20:00"), ("verified_rollback", "local-sensor", "20:00")],
    "demo-ip-shared": [("single_curated_source", "curated-a", "18:00"), ("recent", "curated-a", "20:00"),
                       ("shared_cloud", "curated-a", "20:00"), ("exact_ip", "curated-a", "20:00")],
    "demo-ip-dedicated": [("curated_source", "curated-a", "18:00"), ("curated_source", "curated-b", "18:10"),
                          ("direct_local_detection", "local-sensor", "19:30"), ("recent", "local-sensor", "20:00"),
                          ("exact_ip", "local-sensor", "20:00"), ("dedicated_use", "local-sensor", "20:00"), ("verified_rollback", "local-sensor", "20:00")],
    "demo-dga-fresh": [("behavioral_dga_likelihood", "local-behavioral", "19:45"), ("behavioral_first_seen_novelty", "local-behavioral", "19:45"),
                       ("recent", "local-behavioral", "20:00")],
    "demo-shared-c2": [("curated_source", "curated-a", "19:10"), ("curated_source", "curated-b", "19:20"),
                       ("behavioral_beacon_periodicity", "local-behavioral", "19:40"), ("behavioral_first_seen_novelty", "local-behavioral", "19:45"),
                       ("exact_fqdn", "local-sensor", "20:00"), ("recent", "local-sensor", "20:00"), ("bounded_scope", "local-sensor", "20:00"),
                       ("verified_rollback", "local-sensor", "20:00"), ("shared_cloud", "curated-a", "20:00")],
    "demo-poisoned": [("curated_source", "curated-a", "19:55")],
}
SOURCES = [
    ("curated-a", "curated", True, True, None, True), ("curated-b", "curated", True, True, None, True),
    ("curated-c", "curated", True, True, "curated-a", True), ("local-sensor", "local", True, True, None, True),
    ("local-behavioral", "local", True, True, None, True), ("annotator", "annotation", False, False, None, True),
]


def frames(spark, evidence=EVIDENCE, extra=(), sources=SOURCES):
    inds = spark.createDataFrame([(i, t, v, f"t{n % 2}", "b1", n) for n, (i, t, v) in enumerate(INDICATORS)],
                                 "indicator_id string, itype string, value string, tenant_id string, batch_id string, pos long")
    rows = [(i, *e) for i, items in evidence.items() for e in items] + list(extra)
    rows = [(n, i, k, s, f"2026-09-01T{t}:00Z", "c-1", "interactive_http") for n, (i, k, s, t) in enumerate(rows)]
    ev = spark.createDataFrame(rows, "evidence_id long, indicator_id string, kind string, source_id string, observed_at string, "
                                     "client string, protocol_class string")
    src = spark.createDataFrame(sources, "source_id string, source_class string, independent boolean, auto_enforcement_allowed boolean, "
                                         "upstream string, enabled boolean")
    return inds, ev, src


def run(spark, policy=POLICY, **kw):
    return {r.indicator_id: r for r in decide(*frames(spark, **kw), policy).collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return run(spark)


def test_golden_rungs(golden):
    got = {k: (r.rung, r.action, r.disposition) for k, r in golden.items()}
    assert got == {
        "demo-domain": ("L4", "dns_nxdomain", "SHADOW_ACTION"), "demo-ip-shared": ("L0", "observe", "OBSERVE"),
        "demo-ip-dedicated": ("L5", "firewall_deny", "SHADOW_ACTION"), "demo-dga-fresh": ("L0", "observe", "OBSERVE"),
        "demo-shared-c2": ("L2", "rate_limit", "SHADOW_ACTION"), "demo-poisoned": ("NONE", "none", "NO_ACTION"),
    }


def test_golden_draws_stay_in_bounds(golden):
    limited = golden["demo-shared-c2"]
    assert 120 <= limited.selector.rate_ceiling_per_min <= 240
    assert [r.mechanism for r in limited.randomization] == ["rate_ceiling", "ttl_jitter"]
    assert 2880 <= golden["demo-domain"].ttl_seconds <= 3600 and golden["demo-domain"].nominal_ttl_seconds == 3600
    assert golden["demo-domain"].explanation.startswith("M=100, S_ctx=")


def test_annotations_never_move_a_decision(spark, golden):
    noisy = run(spark, extra=[("demo-domain", "curated_source", "annotator", "19:59")] * 90)
    assert noisy["demo-domain"].decision_id == golden["demo-domain"].decision_id
    assert noisy["demo-domain"].reason_codes == golden["demo-domain"].reason_codes


def test_copies_collapse_and_are_counted(spark, golden):
    copied = run(spark, extra=[("demo-domain", "curated_source", "curated-a", "19:00")] * 70)
    assert "evidence_deduplicated:70" in copied["demo-domain"].reason_codes
    assert copied["demo-domain"].maliciousness == golden["demo-domain"].maliciousness


def test_envelope_caps_after_dedup(spark):
    many = [("demo-poisoned", "curated_source", "curated-a", f"18:{m:02d}") for m in range(60)] + \
           [("demo-poisoned", "curated_source", "curated-b", f"17:{m:02d}") for m in range(20)]
    row = run(spark, extra=many)["demo-poisoned"]
    assert "evidence_envelope_truncated:17" in row.reason_codes and row.maliciousness == 100


def test_reexported_source_is_one_upstream(spark):
    ev = {"demo-poisoned": [("two_curated_sources", "curated-a", "19:55"), ("curated_source", "curated-a", "19:56"), ("curated_source", "curated-c", "19:57")]}
    row = run(spark, evidence=ev)["demo-poisoned"]
    assert "corroboration_claim_unverified:two_curated_sources:distinct_upstreams=1" in row.reason_codes
    assert row.maliciousness == 75 and "unqualified_evidence_present" not in row.reason_codes


def test_disabled_source_loses_authority(spark):
    off = [s if s[0] != "curated-a" else (*s[:5], False) for s in SOURCES]
    assert run(spark, sources=off)["demo-poisoned"].maliciousness == 0


def test_disabled_family_is_dropped_with_reason(spark):
    policy = dataclasses.replace(POLICY, enabled_families=("dga_likelihood",))
    row = run(spark, policy)["demo-dga-fresh"]
    assert "behavioral_family_disabled_by_policy:behavioral_first_seen_novelty" in row.reason_codes


def test_allowlist_only_removes_actions(spark, golden):
    for expires, hit in [(None, True), ("2027-01-01T00:00:00Z", True), ("2025-01-01T00:00:00Z", False), ("soon", False)]:
        policy = dataclasses.replace(POLICY, allowlist=(AllowEntry("c2-demo.invalid", "*", expires),))
        row = run(spark, policy)["demo-domain"]
        assert (row.disposition == "NO_ACTION") == hit, expires


def test_out_of_scope_is_rejected_first(spark):
    policy = dataclasses.replace(POLICY, authorized_domains=("example",), allowlist=(AllowEntry("c2-demo.invalid"),))
    row = run(spark, policy)["demo-domain"]
    assert "out_of_authorized_scope" in row.reason_codes and "allowlist_precedence" not in row.reason_codes


@pytest.mark.parametrize("mode,expected", [
    ("OFF", "NO_ACTION"), ("OBSERVE", "OBSERVE"), ("ENFORCE", "AUTO_ENFORCE"), ("EMERGENCY", "PROPOSE_OPERATOR_APPROVAL")])
def test_modes(spark, mode, expected):
    row = run(spark, dataclasses.replace(POLICY, mode=mode))["demo-domain"]
    assert row.disposition == expected and (row.ttl_seconds > 0) == (mode == "ENFORCE")


def test_action_budget_keeps_payload_order(spark):
    decisions = decide(*frames(spark), POLICY).cache()
    rows = {r.indicator_id: r for r in apply_action_budget(decisions, 2).collect()}
    assert rows["demo-domain"].disposition == rows["demo-ip-dedicated"].disposition == "SHADOW_ACTION"
    late = rows["demo-shared-c2"]
    assert late.disposition == "OBSERVE" and late.decision_id.endswith("-demoted") and late.selector is None
    assert "blast_radius_budget_exceeded" in late.reason_codes
    assert all(r.disposition != "SHADOW_ACTION" for r in apply_action_budget(decisions, 0).collect())


def test_client_impact_budget_reverts_highest_ids(spark):
    policy = dataclasses.replace(POLICY, rung_floors={"L1": (10, 0)}, max_challenged_fraction=0.002, measured_transactions=1000)
    decisions = decide(*frames(spark), policy).cache()
    challenged = sorted(r.decision_id for r in decisions.collect() if r.action == "proxy_challenge")
    assert len(challenged) >= 3
    after = apply_client_impact_budget(decisions, policy).collect()
    assert sorted(r.decision_id for r in after if r.action == "proxy_challenge") == challenged[:2]
    unmeasured = dataclasses.replace(policy, measured_transactions=None)
    assert not [r for r in apply_client_impact_budget(decisions, unmeasured).collect() if r.action == "proxy_challenge"]


def test_tenant_overlay_only_tightens(spark):
    overlays = spark.createDataFrame(
        [{"tenant_id": "t0", "mode": "EMERGENCY", "observe_m": 10, "max_auto_ttl_seconds": 60, "L4_m": 101}], OVERLAY_SCHEMA)
    rows = {r.indicator_id: r for r in decide(*frames(spark), POLICY, overlays=effective_policies(POLICY, overlays)).collect()}
    assert rows["demo-domain"].rung == "L2"          # tenant t0: L4 floor raised out of reach
    assert rows["demo-domain"].nominal_ttl_seconds == 60
    assert rows["demo-domain"].disposition == "SHADOW_ACTION"
    assert run(spark)["demo-poisoned"].decision_id == rows["demo-poisoned"].decision_id


def test_replay_diff_names_changes(spark):
    stricter = dataclasses.replace(POLICY, version="next", rung_floors={**POLICY.rung_floors, "L5": (101, 101), "L2": (101, 101), "L1": (101, 101)})
    kinds = {r.indicator_id: r.change_kind for r in replay_changes(decide(*frames(spark), POLICY), decide(*frames(spark), stricter)).collect()}
    assert kinds["demo-ip-dedicated"] == "block_removed" and kinds["demo-domain"] == "unchanged"


def test_stale_authorizations(spark):
    inds, _, _ = frames(spark)
    actions = spark.createDataFrame([("a1", "d1", "demo-domain", "ENFORCE"), ("a2", "d2", "demo-domain", "SHADOW"), ("a3", "d9", "demo-domain", "SHADOW"),
                                     ("a4", "d1", "gone", "SHADOW")], "action_id string, decision_id string, indicator_id string, mode string")
    decisions = spark.createDataFrame([("d1", "sha-1"), ("d2", "sha-0")], "decision_id string, policy_content_sha256 string")
    policy = dataclasses.replace(POLICY, content_sha256="sha-1")
    got = {r.action_id: r.stale_reason for r in stale_authorizations(actions, inds, decisions, policy).collect()}
    assert got["a1"].startswith("posture_not_permitted") and got["a2"] == "policy_revision_changed"
    assert got["a3"] == "authorizing_decision_missing" and got["a4"] == "indicator_missing"


SPELLINGS = [
    ("2001:db8::7", "ipv6", "2001:DB8:0::7"), ("2001:db8::7", "ipv6", "2001:db8::7/128"), ("2001:db8:1::/48", "cidr", "2001:db8:1::5/48"),
    ("10.0.0.7", "ipv4", "10.0.0.7/32"), ("10.1.0.0/16", "cidr", "10.1.2.3/16"), ("bücher.example", "fqdn", "xn--bcher-kva.example."),
    ("Bücher.example", "fqdn", "BÜCHER.EXAMPLE"), ("1:0:0:2:0:0:0:3", "ipv6", "1:0:0:2::3"), ("a_b.example", "fqdn", "A_b.example.")]


def test_allowlist_keys_meet_in_any_spelling(spark):
    from threatloom.plans.decide import canonical_key
    from threatloom.plans.policy import allow_key

    values = spark.createDataFrame([(v,) for pair in SPELLINGS for v in (pair[0], pair[2])], "v string")
    keys = {r.v: r.k for r in values.select("v", canonical_key(F.col("v")).alias("k")).collect()}
    for value, _, other in SPELLINGS:
        assert keys[value] == keys[other] == allow_key(value) == allow_key(other)


def test_scope_and_reauthorisation_of_both_families(spark):
    from threatloom.plans.budgets import stale_authorizations

    policy = dataclasses.replace(POLICY, mode="ENFORCE", unrestricted=False, authorized_prefixes=("2001:db8::/32", "10.0.0.0/8"), authorized_domains=("example",), allowlist=())
    values = [("in6", "ipv6", "2001:db8::7"), ("long6", "ipv6", "2001:0db8:0:0:0:0:0:8"), ("net6", "cidr", "2001:db8:5::/48"), ("wide6", "cidr", "2001::/16"), ("out6", "ipv6", "2001:db9::1"),
              ("in4", "ipv4", "10.9.9.9"), ("out4", "ipv4", "11.0.0.1"), ("name", "fqdn", "a.example"), ("bad", "ipv6", "2001:db8::zz")]
    indicators = spark.createDataFrame(values, "indicator_id string, itype string, value string")
    actions = spark.createDataFrame([(f"a-{v[0]}", v[0], "ENFORCE", "d") for v in values], "action_id string, indicator_id string, mode string, decision_id string")
    decisions = spark.createDataFrame([("d", policy.content_sha256)], "decision_id string, policy_content_sha256 string")
    stale = {r.indicator_id for r in stale_authorizations(actions, indicators, decisions, policy).collect()}
    assert stale == {"wide6", "out6", "out4", "bad"}


def test_targets_and_prefix_index_match_the_address_library(spark):
    import ipaddress

    from threatloom.operators.targets import covering_prefixes, targets
    from threatloom.plans.policy import allow_key
    from threatloom.session import cut_lineage

    values = ["1.2.3.4", "1.2.3.4.", "1.2.3.4/32", "1.2.3.9/24", "2001:DB8::1", "2001:db8::/32", "2001:db8::5/128", "Example.COM.", "münchen.example", "*.x.example", "::ffff:1.2.3.4", "", "999.1.1.1", "::/0",
              "0.0.0.0/0", "2001:db8:0:0:1::/80", "https://x/32"]
    found = cut_lineage(targets(spark.createDataFrame([(v,) for v in [*values, values[0], None]], "value string")))
    rows = {r.value: r for r in found.collect()}
    assert {v: rows[v]._key for v in values} == {v: allow_key(v) for v in values}
    prefixes = ["1.2.0.0/16", "1.2.3.0/30", "1.2.3.4/32", "0.0.0.0/0", "2001:db8::/29", "2001:db8::/33", "::/0", "2001:DB8:0:0:1::/79", "not a prefix"]
    met = covering_prefixes(found, spark.createDataFrame([(p,) for p in prefixes], "prefix string")).select("value", "prefix", "bits").collect()
    net = lambda t: ipaddress.ip_network(t, strict=False)
    expected = {(v, p, net(p).prefixlen) for v in values if rows[v]._span for p in prefixes[:-1] if net(v).version == net(p).version and net(v).subnet_of(net(p))}
    assert {tuple(r) for r in met} == expected and expected
