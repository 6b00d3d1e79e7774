"""Evidence: provenance, decision-bearing filter, dedup, envelope, attachment.

Evidence rows: evidence_id (unique, input order), indicator_id, kind,
source_id, observed_at (ISO text, '' when unknown), detail map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatloom.functions.instants import recency
from threatloom.functions.digest import sha_hex

# Source classes and evidence kinds with a special role.
UNREGISTERED = "unregistered"
ZERO_WEIGHT_CLASSES = ("annotation", "attribution", "unregistered")
ANY_FALLBACK_CLASSES = ("curated", "local")
EXTERNAL_CLASSES = ("curated", "community")
SHARED_INFRA_KINDS = ("shared_cloud", "shared_cdn", "shared_hosting", "anonymizer", "fastflux_shared")
DEDICATED_USE_KINDS = ("dedicated_use", "dedicated_use_provenance")
CORROBORATION_KINDS = ("single_curated_source", "two_curated_sources")
ASSERTION_KINDS = ("curated_source", "direct_local_detection")
CONTROL_PLANE_KINDS = ("bounded_scope", "verified_rollback", "exactness", "dedicated_use", "dedicated_use_provenance", "recent")
LOCAL_ONLY_KINDS = (
    "behavioral_beacon_periodicity", "behavioral_dga_likelihood", "behavioral_dns_tunneling", "behavioral_fastflux",
    "behavioral_volume_anomaly", "behavioral_first_seen_novelty", "behavioral_tls_metadata_mismatch",
    "behavioral_sync_first_contact",
)
STRIPPED_DETAIL_FIELDS = (
    "kind", "source_id", "observed_at", "points_m", "points_s", "points_s_ctx", "points_s_ip", "independent", "origin",
    "family", "corroboration_group",
)
KNOWN_PROTOCOLS = ("interactive_http", "smtp", "dns", "ics", "ssh", "other")
NON_INTERACTIVE_PROTOCOLS = ("smtp", "dns", "ics", "ssh", "other")


def strip_claims(detail: Column) -> Column:
    """Drop the fields by which a submitter could claim authority or score."""
    return F.map_filter(detail, lambda k, v: ~k.isin(*STRIPPED_DETAIL_FIELDS))


def resolve_source(asserted: Column, kind: Column, channel: Column, allowed_sources: Column, allowed_kinds: Column) -> Column:
    """Authoritative source of a record: the channel, an upstream it carries, or unregistered."""
    proven = (asserted == channel) | F.coalesce(F.array_contains(allowed_sources, asserted), F.lit(False))
    kind_ok = F.coalesce(F.size(allowed_kinds) <= 0, F.lit(True)) | F.coalesce(F.array_contains(allowed_kinds, kind), F.lit(False))
    return F.when(proven & kind_ok, asserted).otherwise(F.lit(UNREGISTERED))


def with_provenance(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach class, effective class, independence identity and authority flags.

    No hint on the join: the registry is broadcast when its measured size
    allows, and a hot source is split by the adaptive skew join otherwise.
    """
    dims = sources.select(
        "source_id", F.col("source_class").alias("_class"), F.col("independent").alias("_independent"),
        F.col("auto_enforcement_allowed").alias("_auto"), F.col("upstream").alias("_upstream"), F.col("enabled").alias("_enabled"))
    known = F.col("_class").isNotNull()
    return evidence.join(dims, "source_id", "left").select(
        *evidence.columns,
        F.coalesce("_class", F.lit(UNREGISTERED)).alias("source_class"),
        F.when(known & F.col("_enabled"), F.col("_class")).otherwise(F.lit(UNREGISTERED)).alias("effective_class"),
        F.when(~known | (F.col("_class") == UNREGISTERED), F.concat(F.lit("unregistered:"), F.col("source_id")))
        .otherwise(F.coalesce(F.when(F.col("_upstream") != "", F.col("_upstream")), F.col("source_id"))).alias("identity"),
        F.coalesce(F.col("_independent") & F.col("_auto"), F.lit(False)).alias("qualified_source"),
    )


def family_of_kind(kind: Column) -> Column:
    family = F.when(kind.startswith("behavioral_"), F.substring(kind, len("behavioral_") + 1, 1 << 30))
    return F.when(family != "", family)


def decision_bearing(evidence: DataFrame, enabled_families: Column | None = None) -> DataFrame:
    """Rows of authoritative sources; ``off`` marks those whose behavioural family the policy disables."""
    if enabled_families is None:
        enabled_families = F.array().cast("array<string>")
    family = family_of_kind(F.col("kind"))
    off = family.isNotNull() & (F.size(enabled_families) > 0) & ~F.coalesce(F.array_contains(enabled_families, family), F.lit(False))
    return evidence.where(~F.col("effective_class").isin(*ZERO_WEIGHT_CLASSES)).withColumn("off", off)


def disabled_kinds(bearing: DataFrame) -> DataFrame:
    """Kinds dropped per indicator because their family is off."""
    return bearing.where("off").groupBy("indicator_id").agg(F.sort_array(F.collect_set("kind")).alias("disabled_kinds"))


def dedup_evidence(evidence: DataFrame) -> DataFrame:
    """First row per (indicator, identity, kind, observed_at), with the group's size as ``copies``.

    Aggregated, not ranked: copies collapse before the shuffle.
    """
    keys = ["indicator_id", "identity", "kind", "observed_at"]
    rest = [c for c in evidence.columns if c not in (*keys, "evidence_id")]
    return evidence.groupBy(*keys).agg(
        F.min(F.struct("evidence_id", *[c for c in rest if c != "detail"])).alias("_first"), F.count("*").alias("copies")
    ).select(*keys, "_first.*", "copies")


def envelope(evidence: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` rows of each indicator; the cap reaches the map side as a window group limit."""
    by_indicator = W.partitionBy("indicator_id").orderBy("evidence_id")
    return evidence.withColumn("_rn", F.row_number().over(by_indicator)).where(F.col("_rn") <= cap).drop("_rn")


def dedup_counts(deduped: DataFrame) -> DataFrame:
    """Per indicator: copies dropped, rows kept, and the kinds of disabled families."""
    on = ~F.col("off")
    return deduped.groupBy("indicator_id").agg(
        F.sum(F.when(on, F.col("copies") - 1).otherwise(0)).alias("dup_dropped"), F.count_if(on).alias("kept"),
        F.sort_array(F.collect_set(F.when(F.col("off"), F.col("kind")))).alias("disabled_kinds"))


def corroboration(evidence: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """Distinct upstream identities freshly asserting maliciousness, and the tier they reach."""
    qualifies = (
        F.col("source_class").isin(*EXTERNAL_CLASSES) & F.col("qualified_source") & F.col("kind").isin(*ASSERTION_KINDS)
        & (recency(F.col("observed_at"), now, max_age_hours) == "fresh"))
    return evidence.groupBy("indicator_id").agg(F.count_distinct(F.when(qualifies, F.col("identity"))).alias("distinct_upstreams")) \
        .withColumn("tier", F.when(F.col("distinct_upstreams") >= 2, 1).otherwise(0))


def independent_sources(sources: DataFrame) -> DataFrame:
    """Distinct upstream identities among independent sources that may corroborate."""
    eligible = F.col("independent") & ~F.col("source_class").isin("annotation", UNREGISTERED)
    identity = F.coalesce(F.when(F.col("upstream") != "", F.col("upstream")), F.col("source_id"))
    return sources.agg(F.count_distinct(F.when(eligible, identity)).alias("independent_sources"))


def observation_context(evidence: DataFrame) -> DataFrame:
    """Most voted client and protocol per indicator; ties go to the smaller text.

    ``evidence`` carries ``client`` and ``protocol_class``. A record stays one row: votes are counted per client, with one count for each
    known protocol, and with map-side combine before they meet per indicator.
    """
    client, protocol = F.trim(F.col("client")), F.trim(F.col("protocol_class"))
    counts = {name: f"_n{k}" for k, name in enumerate(sorted(KNOWN_PROTOCOLS))}
    ballots = evidence.select("indicator_id", F.when(client != "", client).alias("client"), protocol.alias("_protocol"))
    votes = ballots.where(F.col("client").isNotNull() | F.col("_protocol").isin(*KNOWN_PROTOCOLS)).groupBy("indicator_id", "client").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("_protocol") == name).alias(c) for name, c in counts.items()])
    # Ids share their beginning, so the sort compares a number first.
    totals = votes.withColumn("_h", F.xxhash64("indicator_id")).groupBy("_h", "indicator_id").agg(
        F.min(F.when(F.col("client").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("client").alias("v"))))["v"].alias("client"),
        *[F.sum(c).alias(c) for c in counts.values()])
    # The first of the largest counts, in the order of the names.
    most, found = F.greatest(*counts.values()), F.lit(None).cast("string")
    for name, c in reversed(counts.items()):
        found = F.when((F.col(c) == most) & (most > 0), name).otherwise(found)
    return totals.select("indicator_id", "client", found.alias("protocol_class")) \
        .withColumn("protocol_class", F.when(~F.col("protocol_class").isin(*NON_INTERACTIVE_PROTOCOLS), F.col("protocol_class")))


def unambiguous_subject(evidence: DataFrame) -> DataFrame:
    """The one client all beacon and novelty evidence names, else null."""
    about = evidence.where(
        F.col("kind").isin("behavioral_beacon_periodicity", "behavioral_first_seen_novelty") & (F.col("client") != ""))
    return about.groupBy("indicator_id").agg(F.min("client").alias("_lo"), F.max("client").alias("_hi")) \
        .select("indicator_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("subject"))


# --- identity ------------------------------------------------------------------

def observable_id(itype: Column, value: Column, tenant_id: Column) -> Column:
    """Server-derived identity of (tenant, type, canonical value)."""
    trimmed = F.trim(value)
    canonical = F.when(itype == "fqdn", F.lower(F.regexp_replace(trimmed, r"\.+\z", ""))).otherwise(trimmed)
    return F.concat(F.lit("indicator--"), sha_hex(
        F.concat(F.coalesce(tenant_id, F.lit("")), F.lit("|"), itype, F.lit("|"), canonical), 24))


def batch_id(source_id: Column, raw_sha256: Column) -> Column:
    return F.concat(F.lit("batch--"), sha_hex(F.concat(source_id, F.lit("\x1f"), raw_sha256), 24))


def observation_hash(kind: Column, source_id: Column, channel: Column, observed_at: Column, detail: Column, batch: Column) -> Column:
    """Identity of one observation; detail enters as key-sorted JSON."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(detail))))
    return sha_hex(F.concat_ws("|", kind, source_id, F.coalesce(channel, F.lit("")), F.coalesce(observed_at, F.lit("")),
                               F.coalesce(ordered, F.lit("{}")), F.coalesce(batch, F.lit(""))))


# --- attachment ------------------------------------------------------------------

def attach_detections(detections: DataFrame, indicators: DataFrame, types: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(evidence resolved against known indicators, detections still waiting for one).

    Every indicator holding the value receives the evidence, one per tenant.
    ``types`` restricts the indicator types that may match.
    """
    known = indicators.where(F.col("itype").isin(*types)) if types else indicators
    known = known.select(F.col("value").alias("target"), "indicator_id")
    return detections.join(known, "target"), detections.join(known.select("target").distinct(), "target", "left_anti")


def fold_detections(evidence_counts: DataFrame, detections: DataFrame, indicators: DataFrame, cap: int = 1024) -> DataFrame:
    """Offline fold: address detections onto the first indicator of their value, up to ``cap`` records each.

    ``evidence_counts`` holds each indicator's existing record count.
    """
    first = indicators.where(F.col("itype").isin("ipv4", "ipv6")).groupBy(F.col("value").alias("target")) \
        .agg(F.min_by("indicator_id", F.struct(F.when(F.col("itype") == "ipv4", 0).otherwise(1), F.col("pos"))).alias("indicator_id"))
    room = W.partitionBy("indicator_id").orderBy("epoch_s", "kind", "client")
    return (
        detections.join(first, "target")
        .withColumn("_rn", F.row_number().over(room)).where(F.col("_rn") <= cap)
        .join(evidence_counts.select("indicator_id", "n_evidence"), "indicator_id", "left")
        .where(F.col("_rn") + F.coalesce("n_evidence", F.lit(0)) <= cap).drop("_rn", "n_evidence"))
