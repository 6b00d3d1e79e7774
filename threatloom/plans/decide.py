"""Indicators and evidence to decisions: score, gates, ladder, draws.

Fixed values: reason codes (``provenance_violation:`` and the like), dispositions and explanation texts are part of the output contract
and are written out where they arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatloom.functions.digest import micros_of, scaled_draw, sha_hex
from threatloom.functions.instants import recency, utc_literal
from threatloom.functions.net import canonical_cidr, canonical_ip, subnet_of
from threatloom.functions.text import domain_under, idna_name, strip_dots, valid_client
from threatloom.operators import evidence as ev
from threatloom.operators.targets import GovernedLists, governed_marks, targets
from threatloom.plans.policy import Policy, policy_columns, tenant_columns, weights_frame
from threatloom.session import cut_lineage

ADDRESS_TYPES = ("ipv4", "ipv6", "cidr")


def canonical_key(value: Column) -> Column:
    """Allowlist key: addresses and prefixes in canonical form, a prefix of one address as that address, names in IDNA form in lower case.

    A name that IDNA refuses stays as it is, in lower case.
    """
    name = strip_dots(F.trim(value))
    address = F.when(name.contains(":"), F.coalesce(canonical_ip(name), F.regexp_replace(canonical_cidr(name), r"/128\z", ""))) \
        .when(name.rlike(r"\A[0-9./]+\z"), F.regexp_replace(canonical_cidr(name), r"/32\z", ""))
    return F.coalesce(address, F.lower(idna_name(F.lower(name))), F.lower(name))


def with_target(df: DataFrame) -> DataFrame:
    """Columns the gates read: ``_span`` (address range), ``_name`` (domain form), ``_key`` (allowlist form); once per distinct value."""
    return df.join(targets(df).select("value", "_span", "_name", "_key"), "value", "left")


def in_scope(p: dict[str, Column]) -> Column:
    """Inside the authorised prefixes or domains; an empty list authorises nothing. Needs ``with_target``."""
    span, name = F.col("_span"), F.col("_name")
    by_address = F.coalesce(F.exists(p["authorized_ranges"], lambda r: subnet_of(span, r)), F.lit(False))
    by_name = F.coalesce(F.exists(p["authorized_domains"], lambda d: domain_under(name, d)), F.lit(False))
    return p["unrestricted"] | F.when(F.col("itype").isin(*ADDRESS_TYPES), by_address).otherwise(by_name)


def allowlisted(p: dict[str, Column]) -> Column:
    """First unexpired matching entry protects, unless its expiry cannot be read. Needs ``with_target``."""
    key, scope = F.col("_key"), p["scope"]
    matching = F.filter(p["allowlist"], lambda e: (e["canonical"] == key) & (key != "") & ((e["scope"] == scope) | (e["scope"] == "*")) & ~e["expired"])
    return F.coalesce(F.try_element_at(matching, F.lit(1))["readable"], F.lit(False))


def score(bounded: DataFrame, facts: DataFrame, weights: DataFrame, max_age_hours: float) -> DataFrame:
    """Per indicator: score sums, flags, families and reason codes.

    ``bounded`` is the enveloped evidence, at most ``max_evidence`` rows per
    indicator and already partitioned by it, so the windows and the final
    aggregate add no shuffle. ``facts`` holds one row per indicator with the
    server-derived facts and the policy instant ``now``.
    """
    kind, cls = F.col("kind"), F.col("effective_class")
    rows = bounded.join(facts, "indicator_id").withColumn("fresh", recency(F.col("observed_at"), F.col("now"), max_age_hours) == "fresh")
    everyone = W.partitionBy("indicator_id")
    external = F.when(cls.isin(*ev.EXTERNAL_CLASSES) & F.col("qualified_source") & kind.isin(*ev.ASSERTION_KINDS) & F.col("fresh"), F.col("identity"))
    rows = rows.withColumn("any_fresh", F.max("fresh").over(everyone)) \
        .withColumn("upstreams", F.size(F.collect_set(external).over(everyone)))

    # The weight table is a fixed local relation of a few dozen rows.
    rows = rows.join(F.broadcast(weights), ["effective_class", "kind"], "left")
    weight = {c: F.coalesce(F.col(f"w_{c}"), F.lit(0)) for c in ("m", "s_ctx", "s_ip")}
    weighted = F.col("w_m").isNotNull()
    fresh = F.col("fresh")
    fact_holds = (
        F.when(kind == "recent", F.col("any_fresh")).when(kind == "bounded_scope", F.col("in_scope"))
        .when(kind == "exactness", F.col("exactness")).when(kind.isin(*ev.DEDICATED_USE_KINDS), F.col("dedicated_use"))
        .when(kind == "verified_rollback", F.col("verified_rollback")))
    rows = rows.withColumn("_standing", F.when(kind.isin(*ev.LOCAL_ONLY_KINDS) & (cls != "local"), "violation")
                           .when(kind.isin(*ev.CONTROL_PLANE_KINDS) & ~F.coalesce(fact_holds, F.lit(False)), "unverified").otherwise("counted"))
    violation, unverified, counted = (F.col("_standing") == x for x in ("violation", "unverified", "counted"))
    m = F.when(fresh, weight["m"]).otherwise(F.least(F.lit(0), weight["m"]))
    needed = F.when(kind == "two_curated_sources", 2).otherwise(1)
    rows = rows.withColumn("_unproven", counted & kind.isin(*ev.CORROBORATION_KINDS) & (weight["m"] > 0) & fresh & (F.col("upstreams") < needed))
    unproven = F.col("_unproven")
    rows = (
        rows
        .withColumns({
            "_m": F.when(~counted, 0).when(unproven, F.coalesce("plain_m", F.lit(0))).otherwise(m),
            "_s_ctx": F.when(counted & fresh & ~kind.isin(*ev.SHARED_INFRA_KINDS), weight["s_ctx"]).otherwise(0),
            "_s_ip": F.when(counted & fresh, weight["s_ip"]).otherwise(0)})
        .withColumn("_reasons", F.array_compact(F.array(
            F.when(violation, F.concat(F.lit("provenance_violation:"), kind)),
            F.when(unverified, F.concat(F.lit("control_plane_claim_unverified:"), kind)),
            F.when(counted & ~weighted, F.concat(F.lit("unweighted:"), cls, F.lit(":"), kind)),
            F.when(unproven, F.concat(F.lit("corroboration_claim_unverified:"), kind, F.lit(":distinct_upstreams="), F.col("upstreams"))),
            F.when((F.col("_m") != 0) | (F.col("_s_ctx") != 0) | (F.col("_s_ip") != 0), kind))))
        .withColumn("_unqualified", violation | unverified | ~weighted)
        .withColumn("_dedicated", counted & kind.isin(*ev.DEDICATED_USE_KINDS) & fresh)
        .withColumn("_local_family", (cls == "local") & kind.startswith("behavioral_"))
    )
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    return rows.groupBy("indicator_id").agg(
        F.sum("_m").alias("m_total"), F.sum(F.when(F.col("_local_family"), F.col("_m")).otherwise(0)).alias("bm"),
        clamp(F.sum("_s_ctx")).alias("s_ctx"), clamp(F.sum("_s_ip")).alias("s_ip"),
        F.max("_dedicated").alias("has_dedicated"), F.max("_unqualified").alias("has_unqualified"),
        F.max(kind.isin(*ev.SHARED_INFRA_KINDS)).alias("has_shared"), F.max("upstreams").alias("external_upstreams"),
        F.size(F.collect_set(F.when(F.col("_local_family"), kind))).alias("families"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_reasons")))).alias("reasons"))


def with_lists(indicators: DataFrame, policy: Policy, p: dict[str, Column], lists: GovernedLists) -> DataFrame:
    """``in_scope``, ``_listed``, ``_dedicated`` and ``_rollback`` from lists that are tables: one index join a list over distinct targets."""
    # Written once: every list reads it.
    found = cut_lineage(targets(indicators))
    marks = governed_marks(indicators, found, lists, policy.scope, utc_literal(policy.now))
    marked = indicators.join(marks, "indicator_id")
    scope = F.when(F.col("itype").isin(*ADDRESS_TYPES), F.col("_by_address")).otherwise(F.col("_by_name"))
    return marked.withColumn("in_scope", p["unrestricted"] | scope).drop("_by_address", "_by_name")


def scored_indicators(indicators: DataFrame, evidence: DataFrame, sources: DataFrame, policy: Policy,
                      p: dict[str, Column] | None = None, lists: GovernedLists | None = None) -> DataFrame:
    """Indicators with maliciousness, safety scores and score reasons.

    ``p`` gives policy columns present on ``indicators`` (tenant policies);
    without it the policy is literal. ``lists`` replaces the policy's scope,
    allowlist and governed lists by tables.
    """
    p = p or policy_columns(policy)
    cap = max(1, policy.max_evidence_per_indicator)
    if lists is None:
        indicators = with_target(indicators).withColumn("in_scope", in_scope(p))
        dedicated, rollback = (F.array_contains(p[f"governed_{n}"], F.col("value")) for n in ("dedicated_use", "verified_rollback"))
    else:
        indicators = with_lists(indicators, policy, p, lists)
        dedicated, rollback = F.col("_dedicated"), F.col("_rollback")
    facts = indicators.select(
        "indicator_id", "in_scope", (F.col("value") != "").alias("exactness"), dedicated.alias("dedicated_use"), rollback.alias("verified_rollback"),
        p["now"].alias("now"), p["enabled_families"].alias("_families"), p["max_evidence_per_indicator"].alias("_cap"))
    proven = ev.with_provenance(evidence.select("evidence_id", "indicator_id", "kind", "source_id", F.coalesce("observed_at", F.lit("")).alias("observed_at")), sources)
    tenant_gate = "_policy" in indicators.columns
    if tenant_gate:
        proven = proven.join(facts.select("indicator_id", "_families"), "indicator_id")
        bearing = ev.decision_bearing(proven, F.col("_families")).drop("_families")
    else:
        bearing = ev.decision_bearing(proven, p["enabled_families"])
    # Rows of disabled families pass through the same aggregate, only to be counted and named.
    deduped = ev.dedup_evidence(bearing)
    # Asking for ``copies`` on both sides leaves both the same aggregate, so that records are sorted and shuffled for it once.
    bounded = ev.envelope(deduped.where("not off and copies > 0"), cap)
    if tenant_gate:
        own = W.partitionBy("indicator_id").orderBy("evidence_id")
        bounded = bounded.join(facts.select("indicator_id", "_cap"), "indicator_id") \
            .withColumn("_rn", F.row_number().over(own)).where("_rn <= _cap").drop("_rn", "_cap")
    scores = score(bounded.drop("copies", "off"), facts.drop("_families", "_cap"), weights_frame(indicators.sparkSession), policy.recency_max_age_hours)
    joined = indicators.join(scores, "indicator_id", "left").join(ev.dedup_counts(deduped), "indicator_id", "left") \
        .withColumn("truncated", F.greatest(F.col("kept") - p["max_evidence_per_indicator"], F.lit(0)))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("m_total", "bm", "s_ctx", "s_ip", "families", "external_upstreams", "dup_dropped", "truncated")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_dedicated", "has_unqualified", "has_shared")}
    joined = joined.withColumns({**zero, **flags})
    cap_m = F.when(F.col("families") == 0, F.lit(100)) \
        .when(F.col("families") >= F.greatest(F.lit(1), p["rate_limit_families"]), p["corroborated_max_behavioral_m"]) \
        .otherwise(p["max_behavioral_m"])
    capped = F.col("bm") > cap_m
    clamped = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    extra = F.array_compact(F.array(
        F.when(F.col("dup_dropped") > 0, F.concat(F.lit("evidence_deduplicated:"), F.col("dup_dropped"))),
        F.when(F.col("truncated") > 0, F.concat(F.lit("evidence_envelope_truncated:"), F.col("truncated"))),
        F.when(capped, F.lit("behavioral_m_capped")), F.when(F.col("has_unqualified"), F.lit("unqualified_evidence_present"))))
    disabled = F.transform(F.coalesce("disabled_kinds", F.array().cast("array<string>")),
                           lambda k: F.concat(F.lit("behavioral_family_disabled_by_policy:"), k))
    return (
        joined
        .withColumn("m", F.when(capped, clamped(F.col("m_total") - F.col("bm") + cap_m)).otherwise(clamped(F.col("m_total"))).cast("long"))
        .withColumn("score_reasons", F.concat(F.coalesce("reasons", F.array().cast("array<string>")), extra, disabled))
        .withColumn("infra_state", F.when(F.col("has_shared"), "shared").when(F.col("has_dedicated"), "dedicated").otherwise("unknown"))
        .drop("reasons", "disabled_kinds", "m_total", "dup_dropped", "kept", "truncated", "has_shared", "has_unqualified"))


def _flag(condition: Column, reason: str) -> Column:
    return F.when(condition, F.lit(reason))


def apply_ladder(scored: DataFrame, policy: Policy, p: dict[str, Column] | None = None) -> DataFrame:
    """Rung, action and disposition of every scored indicator, with draws, ids and explanation.

    ``scored`` carries ``client`` and ``protocol_class`` (null when unknown).
    """
    p = p or policy_columns(policy)
    c = F.col
    itype, value, m, s_ctx, s_ip = c("itype"), c("value"), c("m"), c("s_ctx"), c("s_ip")
    ip, fqdn, cidr = itype.isin("ipv4", "ipv6"), itype == "fqdn", itype == "cidr"
    external = c("external_upstreams") > 0
    mode = p["mode"]

    unsafe = c("client").isNotNull() & ~valid_client(c("client"))
    if "_listed" in scored.columns:
        allow = c("_listed") & p["allowlist_precedence"]
    else:
        allow = allowlisted(p) & p["allowlist_precedence"] if policy.allowlist else F.lit(False)
    df = scored.withColumns({
        "_client": F.when(~unsafe, c("client")), "_allow": allow,
        "_no_dedicated": (c("infra_state") != "dedicated") | ~c("has_dedicated"),
        "_thin": (c("families") > 0) & (c("families") < p["deny_families"]),
        "_alone": (c("families") > 0) & p["deny_requires_external"] & ~external,
        "_interactive": c("protocol_class").isNotNull() & ~c("protocol_class").isin(*ev.NON_INTERACTIVE_PROTOCOLS)})
    has_client = c("_client").isNotNull() & (c("_client") != "")
    no_dedicated, thin, alone, interactive = c("_no_dedicated"), c("_thin"), c("_alone"), c("_interactive")
    deny_ok = ~thin & ~alone

    # Per rung: offered to this type, its gate, its floors. Kept as columns, since reasons read them again.
    offered = {"L5": ip & deny_ok, "L4": fqdn & deny_ok, "L2": ip | fqdn, "L1": ~cidr}
    gate = {"L5": ~no_dedicated, "L4": F.lit(True), "L2": has_client, "L1": interactive & has_client}
    floors = {r: (m >= p[f"{r}_m"]) & ((s_ip if r == "L5" else s_ctx) >= p[f"{r}_s"]) for r in offered}
    df = df.withColumns({
        **{f"_offered_{r}": offered[r] & p[f"{r}_m"].isNotNull() for r in offered}, **{f"_gate_{r}": gate[r] for r in gate},
        **{f"_meets_{r}": floors[r] for r in floors}})
    offered, gate, meets = ({r: c(f"_{part}_{r}") for r in floors} for part in ("offered", "gate", "meets"))
    rung = F.lit("L0")
    for r in ("L1", "L2", "L4", "L5"):
        rung = F.when(offered[r] & gate[r] & meets[r], F.lit(r)).otherwise(rung)
    ladder_reasons = [
        _flag(unsafe, "client_selector_unsafe_for_artifacts"), _flag(thin, "behavioral_corroboration_insufficient"),
        _flag(alone, "behavioral_deny_needs_external_corroboration"),
        _flag(ip & no_dedicated & (c("infra_state") == "shared"), "demoted_shared_infra"),
        _flag(ip & no_dedicated & (c("infra_state") != "shared"), "demoted_unknown_infra"),
        _flag(offered["L1"] & ~interactive, "l1_requires_interactive_protocol"),
        _flag(offered["L1"] & ~has_client, "l1_requires_client_selector"), _flag(offered["L2"] & ~has_client, "l2_requires_pair_selector"),
        *[_flag(offered[r] & gate[r] & ~meets[r], f"below_{r}_floor") for r in offered],
    ]

    wildcard = fqdn & value.contains("*") & ~p["auto_wildcard_domain"]
    path = (
        F.when(~c("in_scope"), "out_of_scope").when(c("_allow"), "allowlisted")
        .when((mode == "OFF") | (m < p["observe_m"]), "quiet").when(mode == "OBSERVE", "observe").when(wildcard, "wildcard")
        .when(cidr & (mode != "EMERGENCY"), "cidr").otherwise("ladder"))
    df = df.withColumn("_path", path).withColumn("_rung", F.when(c("_path") == "ladder", rung))
    acts = F.coalesce(c("_rung") != "L0", F.lit(False))
    at = c("_path")
    escalated = F.when(mode == "EMERGENCY", "PROPOSE_OPERATOR_APPROVAL").when(mode == "ENFORCE", "AUTO_ENFORCE").otherwise("SHADOW_ACTION")
    held = F.when(mode.isin("EMERGENCY", "ENFORCE"), "PROPOSE_OPERATOR_APPROVAL").otherwise("SHADOW_ACTION")
    df = (
        df
        .withColumn("rung", F.when(at == "observe", "L0").when(at == "wildcard", "L4").when(at == "ladder", c("_rung")).otherwise("NONE"))
        .withColumn("disposition", F.when(at == "observe", "OBSERVE").when(at == "wildcard", held).when(at == "cidr", "OBSERVE")
                    .when((at == "ladder") & acts, escalated).when(at == "ladder", "OBSERVE").otherwise("NO_ACTION"))
        .withColumn("action", F.when(at == "observe", "observe").when(at == "wildcard", "dns_nxdomain").when(at == "cidr", "firewall_deny")
                    .when(at == "ladder", F.when(c("_rung") == "L1", "proxy_challenge").when(c("_rung") == "L2", "rate_limit")
                          .when(c("_rung") == "L4", "dns_nxdomain").when(c("_rung") == "L5", "firewall_deny").otherwise("observe"))
                    .otherwise("none"))
    )
    emergency = (mode == "EMERGENCY") & at.isin("wildcard", "ladder") & (c("rung") != "L0")
    gate_reasons = [
        _flag(at == "out_of_scope", "out_of_authorized_scope"), F.when(at == "allowlisted", F.concat(F.lit("allowlist_hit:"), value)),
        _flag(at == "allowlisted", "allowlist_precedence"), _flag(at == "wildcard", "wildcard_requires_approval"),
        _flag(at == "cidr", "prefix_requires_approval"), _flag(at == "cidr", "materialization_unavailable:no_supported_adapter"),
        _flag(emergency, "emergency_mode"), *[F.when(at == "ladder", r) for r in ladder_reasons],
    ]
    reasons = F.array_sort(F.array_distinct(F.concat(c("score_reasons"), F.array_compact(F.array(*gate_reasons)))))

    version, scope = p["version"], p["scope"]
    bar = lambda *parts: F.concat_ws("|", *[x.cast("string") for x in parts])
    df = df.withColumn("reason_codes", reasons).withColumn("decision_id", F.concat(F.lit("decision--"), sha_hex(bar(
        c("indicator_id"), itype, value, version, m, s_ctx, s_ip, c("action"), c("disposition"), c("rung"), scope), 24)))

    ladder_ttl = (at == "ladder") & acts & (mode != "EMERGENCY")
    nominal_ttl = F.when(ladder_ttl, F.least(F.lit(3600), p["max_auto_ttl_seconds"])).otherwise(0).cast("long")
    df = df.withColumn("nominal_ttl_seconds", nominal_ttl)
    limited = c("rung") == "L2"
    record_type = "struct<mechanism:string,bounds_version:string,epoch:string,seed_id:string,fraction_micros:bigint,drawn:bigint>"
    none = F.lit(None).cast(record_type)
    bounds, epoch = p["bounds_version"], p["epoch"]
    ceiling, ceiling_record = F.lit(policy.nominal_rate_ceiling).cast("long"), none
    if policy.randomization and policy.rate_ceiling_jitter:
        body = bar(c("indicator_id"), itype, value, version, m, s_ctx, scope, bounds, epoch)
        drawn, fraction = scaled_draw(F.concat(F.lit("rate-ceiling|"), body), p["nominal_rate_ceiling"], *policy.rate_ceiling_jitter, policy.draw_domain)
        df = df.withColumns({"_ceiling": F.when(limited, drawn), "_ceiling_fraction": F.when(limited, fraction)})
        ceiling = c("_ceiling")
        ceiling_record = F.when(limited, F.struct(
            F.lit("rate_ceiling").alias("mechanism"), bounds.alias("bounds_version"), epoch.alias("epoch"),
            F.concat(F.lit("seed--rate-ceiling--"), sha_hex(body, 12)).alias("seed_id"), c("_ceiling_fraction").alias("fraction_micros"),
            c("_ceiling").alias("drawn")))
    ttl, ttl_record, jitter_note = c("nominal_ttl_seconds"), none, F.lit("")
    if policy.randomization and policy.ttl_jitter:
        seed = bar(F.lit("ttl-jitter"), c("decision_id"), bounds, epoch)
        drawn, fraction = scaled_draw(seed, c("nominal_ttl_seconds"), *policy.ttl_jitter, policy.draw_domain)
        timed = c("nominal_ttl_seconds") > 0
        df = df.withColumns({"_ttl": F.when(timed, drawn).otherwise(0).cast("long"), "_ttl_fraction": F.when(timed, fraction)})
        ttl = c("_ttl")
        ttl_record = F.when(timed, F.struct(
            F.lit("ttl_jitter").alias("mechanism"), bounds.alias("bounds_version"), epoch.alias("epoch"),
            F.concat(F.lit("seed--"), sha_hex(seed, 16)).alias("seed_id"), c("_ttl_fraction").alias("fraction_micros"), c("_ttl").alias("drawn")))
        jitter_note = F.when(timed, F.concat(F.lit(" ttl_jitter="), F.format_string("%.3f", c("_ttl_fraction") / F.lit(1_000_000.0)), F.lit("."))).otherwise("")
    df = df.withColumn("ttl_seconds", ttl).withColumn("selector", F.when(c("rung").isin("L1", "L2") & (at == "ladder"), F.struct(
        F.when(limited, "client_destination_pair").otherwise("client_session").alias("scope_type"), c("_client").alias("client"),
        value.alias("destination"), c("protocol_class").alias("protocol_class"),
        F.when(limited, ceiling).alias("rate_ceiling_per_min"))))
    df = df.withColumn("randomization", F.array_compact(F.array(ceiling_record, ttl_record)))

    yes = lambda b: F.when(b, "True").otherwise("False")
    ceiling_note = F.when(c("selector.rate_ceiling_per_min").isNotNull(),
                          F.concat(F.lit(", rate_ceiling_per_min="), c("selector.rate_ceiling_per_min"))).otherwise("")
    scores = F.format_string("M=%d, S_ctx=%d", m, s_ctx)
    explanation = (
        F.when(at == "out_of_scope", F.concat(F.lit("Target outside authorized scope; no action possible. "), scores, F.lit(".")))
        .when(at == "allowlisted", F.concat(F.lit("Allowlisted target; enforcement suppressed. "), scores, F.lit(".")))
        .otherwise(F.concat(F.format_string(
            "%s, S_ip=%d, type=%s, infra=%s, families=%d, external_qualified=%s, mode=%s, rung=%s, disposition=%s, action=%s",
            scores, s_ip, itype, c("infra_state"), c("families"), yes(external), mode, c("rung"), c("disposition"), c("action")),
            ceiling_note, F.lit("."), jitter_note)))
    content = F.concat_ws("\x1f", c("disposition"), c("action"), c("rung"), c("ttl_seconds").cast("string"),
                          F.coalesce(F.to_json("selector"), F.lit("null")), F.to_json("randomization"), version)
    carried = [n for n in ("tenant_id", "batch_id", "pos") if n in scored.columns]
    return df.select(
        "decision_id", "indicator_id", "itype", "value", *carried, m.alias("maliciousness"), s_ctx.alias("s_ctx"), s_ip.alias("s_ip"),
        F.when(c("rung") == "L5", s_ip).otherwise(s_ctx).alias("action_safety"), "disposition", "action", "rung", scope.alias("scope"),
        "ttl_seconds", "nominal_ttl_seconds", version.alias("policy_version"), "reason_codes", explanation.alias("explanation"),
        "selector", "randomization",
        F.when(c("disposition") != "NO_ACTION", F.concat(F.lit("hash--"), sha_hex(content, 24))).otherwise("").alias("content_hash"),
        "infra_state", c("families").alias("behavioral_families"), external.alias("external_qualified"))


def decide(indicators: DataFrame, evidence: DataFrame, sources: DataFrame, policy: Policy, overlays: DataFrame | None = None,
           context: DataFrame | None = None, lists: GovernedLists | None = None) -> DataFrame:
    """Decisions for all indicators.

    ``context`` (indicator_id, client, protocol_class) defaults to the vote of
    the evidence's own ``client`` and ``protocol_class`` columns. ``overlays``
    is the table of effective tenant policies. ``lists``: scope, allowlist and
    governed lists as tables, which then count instead of the policy's own.
    """
    p = policy_columns(policy)
    if overlays is not None:
        indicators = indicators.join(overlays, "tenant_id", "left")
        p = tenant_columns(policy)
    if context is None and {"client", "protocol_class"} <= set(evidence.columns):
        context = ev.observation_context(evidence)
    scored = scored_indicators(indicators, evidence, sources, policy, p, lists)
    if context is None:
        scored = scored.withColumns({"client": F.lit(None).cast("string"), "protocol_class": F.lit(None).cast("string")})
    else:
        scored = scored.join(context, "indicator_id", "left")
    return apply_ladder(scored, policy, p)
